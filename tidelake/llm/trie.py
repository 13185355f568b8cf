"""The prefix trie of conversations, by van Emde Boas recursion.

A conversation is a sequence of turns; a turn counts by the digest of its role
and text. A (sub)problem is the depths ``(s, s + 2m]`` below a node that
already has a name. It is cut at half depth, s + m: the cut prefixes are named
from the name at s and the fingerprint of the m turns between, which a tree of
digests over pairs gives without walking them one by one. The upper trie
(s, s + m] and the lower forests (s + m, s + 2m], one below each cut prefix,
are then problems of half the depth, and all problems of one depth go at once.
So each depth d is the cut of exactly one problem, whose half depth m is d's
lowest set bit, and a node's name is reached in at most log2(d) steps.

1. Turns are numbered (``ordered``), conversations are rebuilt.
2. Names. Sequences are dealt in tiles of TILE turns, so a conversation of any
   length is spread. Tiles of longer conversations become the turns of a
   shorter sequence, named by the same function, which gives every tile the
   name it hangs below (and the cuts above it).
3. Nodes: one partly aggregated group-by over names.
4. Totals are grafted upward. A cut node's total is its own value, plus the
   values inside the lower forest below it (one group-by over all nodes,
   listed under the cuts above them), plus the totals of the nodes that end
   that forest, which were cuts of larger problems. So totals are ready after
   one round for each problem size, largest first, and the sizes of the
   rounds fall with the depth.

Each round's result is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import prepare, stash
from tidelake.llm.ordered import TURN_ORDER, numbered, turn_keys, word_count

#: Turns of a conversation that one tile holds; a power of two.
TILE = 1 << 10
#: The name of the node without a turn.
ROOT = bytes(16)
#: Ids that a piece of an end list holds at most.
IDS = 1 << 16


def _joined(a: bytes, b: bytes) -> bytes:
    return hashlib.md5(a + b).digest()


def fingerprints(turns: list[bytes]) -> list[list[bytes]]:
    """Fingerprints of the aligned runs of 1, 2, 4, ... turns; only whole runs have one."""
    levels = [turns]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_joined(below[k], below[k + 1]) for k in range(0, len(below) - 1, 2)])
    return levels


def cut_names(turns: list[bytes], above: list[bytes]) -> list[list[bytes]]:
    """For each depth 0..n the names of the cuts on the way to it, its own name last.

    ``above`` is this list for the node below which the turns hang.
    """
    prints = fingerprints(turns)
    ways: list = [above] + [None] * len(turns)
    for level in range(len(prints) - 1, -1, -1):
        half = 1 << level
        for start in range(0, len(turns), 2 * half):
            if start + half <= len(turns):
                way = ways[start]
                ways[start + half] = [*way, _joined(way[-1] if way else ROOT, prints[level][start >> level])]
    return ways


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with shared openings: (conv_id, depth, token, words) and (conv_id, turns).

    Conversation c starts with the first h turns of conversation c - c % ``group``
    and goes on with its own turns after its first h; h = crc32(c in decimal) % ``heads``.
    """
    rows = numbered(
        turns.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .select("conv_id", *turn_keys(), word_count(F.col("text")).alias("words")),
        "conv_id", TURN_ORDER, "trie-turns").select("conv_id", "at", "d1", "d2", "words")
    # The digest as one value: both halves in a fixed width.
    rows = rows.select("conv_id", "at", F.unhex(F.concat(*[F.lpad(F.hex(d), 16, "0") for d in ("d1", "d2")])).alias("token"), "words")
    convs = rows.groupBy("conv_id").agg(F.max("at").alias("n")).select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = stash(convs.join(bases, "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lent"),
        (F.least("h", F.coalesce("n_base", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "trie-conversations")
    own = (rows.join(convs.select("conv_id", "h", "lent"), "conv_id").where("at > h")
           .select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("depth"), "token", "words"))
    first = rows.where(F.col("at") < heads).select(F.col("conv_id").alias("base"), "at", "token", "words")
    lent = (convs.where("lent > 0").select("conv_id", "base", "h").join(first, "base").where("at <= h")
            .select("conv_id", F.col("at").alias("depth"), "token", "words"))
    return stash(own.union(lent), "trie-rebuilt"), convs.select("conv_id", "turns")


def _tiles(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """(key, columns) for each run of rows of one conversation and tile, in order of depth."""
    key, held = None, {n: [] for n in names}
    for batch in batches:
        rows = {n: batch.column(n).to_pylist() for n in ("conv_id", "tile", *names)}
        for k in range(batch.num_rows):
            here = rows["conv_id"][k], rows["tile"][k]
            if here != key:
                if key is not None:
                    yield key, held
                key, held = here, {n: [] for n in names}
            for n in names:
                held[n].append(rows[n][k])
    if key is not None:
        yield key, held


def _tile() -> Column:
    return F.shiftright(F.col("depth") - 1, TILE.bit_length() - 1)


def _by_tile(sequences: DataFrame) -> DataFrame:
    return (sequences.withColumn("tile", _tile())
            .repartition("conv_id", "tile").sortWithinPartitions("conv_id", "tile", "depth"))


def named(sequences: DataFrame, with_own: bool = False) -> DataFrame:
    """(conv_id, depth, words, way, name) of sequences (conv_id, depth, token, words): the node of
    each prefix, and the names of the cuts on the way to the prefix of one turn less, its parent
    (or, ``with_own``, to the prefix itself), in order of depth."""
    deepest = sequences.agg(F.max("depth")).first()[0] or 0
    size = TILE

    def tile_prints(batches):
        out: list = []
        for (conv, tile), held in _tiles(batches, ["token"]):
            if len(held["token"]) == size:
                out.append((conv, tile + 1, fingerprints(held["token"])[-1][0]))
        yield _batch(out, [("conv_id", pa.int64()), ("depth", pa.int64()), ("token", pa.binary())])

    def name(batches):
        out: list = []
        fields = [("conv_id", pa.int64()), ("depth", pa.int64()), ("words", pa.int64()), ("way", pa.list_(pa.binary())), ("name", pa.binary())]
        for (conv, tile), held in _tiles(batches, ["token", "words", "above"]):
            ways = cut_names(held["token"], held["above"][0] or [])
            if len(ways) > size and held["above"][-1]:
                ways[-1] = held["above"][-1]
            out += [(conv, tile * size + k + 1, words, ways[k + with_own], ways[k + 1][-1]) for k, words in enumerate(held["words"])]
            if len(out) >= 2000:
                yield _batch(out, fields)
                out = []
        yield _batch(out, fields)

    if deepest <= size:
        tiles = sequences.withColumn("above", F.lit(None).cast("array<binary>"))
    else:
        prints = stash(_by_tile(sequences.select("conv_id", "depth", "token"))
                       .mapInArrow(tile_prints, "conv_id long, depth long, token binary"), "trie-tiles")
        above = named(prints.withColumn("words", F.lit(0).cast("long")), with_own=True).select(
            F.col("conv_id").alias("c"), F.col("depth").alias("t"), F.col("way").alias("above"))
        # A tile needs the way to its start at its first turn, and the way to its end, which is a cut
        # of a larger problem, at its last one.
        edge = (F.col("depth") % size).isin(0, 1)
        ends = sequences.where(edge).withColumn("at_tile", F.shiftright(F.col("depth"), size.bit_length() - 1))
        tiles = (ends.join(above, (F.col("conv_id") == F.col("c")) & (F.col("at_tile") == F.col("t")), "left").drop("c", "t", "at_tile")
                 .union(sequences.where(~edge).withColumn("above", F.lit(None).cast("array<binary>"))))
    return _by_tile(tiles).mapInArrow(name, "conv_id long, depth long, words long, way array<binary>, name binary")


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _problem(depth: Column) -> Column:
    """log2 of a depth's lowest set bit: the half depth of the problem whose cut it is."""
    return F.bit_count((depth - 1).bitwiseAND(F.bitwise_not(depth)))


def _grafted(nodes: DataFrame, deepest: int) -> DataFrame:
    """``nodes`` (name, way, depth, leaves, saved and more) with leaves and saved summed over subtrees."""
    ends = _problem(F.col("depth"))
    # A node lies inside the forests below all its cuts but those whose forest it ends: the last `ends` ones.
    inside = (nodes.select(F.explode(F.slice("way", F.lit(1), F.size("way") - ends)).alias("cut"), "leaves", "saved")
              .groupBy("cut").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    nodes = stash(nodes.join(inside, F.col("name") == F.col("cut"), "left").select(
        *[c for c in nodes.columns if c not in ("leaves", "saved")], ends.alias("level"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "trie-inside")
    done: DataFrame | None = None
    for level in range(max(deepest, 1).bit_length() - 1, -1, -1):
        cuts = nodes.where(F.col("level") == level)
        if done is not None:
            below = (done.groupBy(F.element_at("way", -1 - level).alias("cut"))
                     .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
            cuts = cuts.join(below, F.col("name") == F.col("cut"), "left").select(
                *[c for c in nodes.columns if c not in ("leaves", "saved")],
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        cuts = stash(cuts, "trie-totals")
        done = cuts if done is None else done.union(cuts)
    return done


def _end_lists(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id): ids ascending, in decimal, joined by commas.

    Ids are sorted in pieces of at most IDS; a task then streams a node's pieces through the hash.
    """
    pieces = (ends.groupBy("name", F.floor(F.col("conv_id") / F.lit(IDS)).alias("piece"))
              .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
              .repartition("name").sortWithinPartitions("name", "piece"))

    def run(batches):
        name, state, out = None, None, []
        fields = [("name", pa.binary()), ("ends_sha256", pa.string())]
        for batch in batches:
            for here, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if here != name:
                    if state is not None:
                        out.append((name, state.hexdigest()))
                    name, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= 2000:
                yield _batch(out, fields)
                out = []
        if state is not None:
            out.append((name, state.hexdigest()))
        yield _batch(out, fields)

    return pieces.select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (``rebuilt``).

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; root: null), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (summed over its
    subtree: (n_convs - 1) * words of each node's last turn), ends_sha256 (members of just its depth).

    ``turns``: conv_id (an integer), turn, role, text; further columns are ignored. Null roles and
    texts count as empty, null turns come first, equal turns are ordered by role and text
    (``ordered.turn_keys``) and repeated rows are turns of their own. Rows without a conv_id belong
    to no conversation. A text of any length is one turn, known by its digest. A conversation whose
    rebuilt form has no turn is a member of the root; an empty table has no members and gives no rows.
    """
    prepare(turns.sparkSession)
    sequences, convs = rebuilt(turns)
    places = stash(named(sequences), "trie-places")
    nodes = places.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"),
        F.first("words").alias("words"), F.first("way").alias("way"))
    parent = F.when(F.size("way") > 0, F.element_at("way", -1)).otherwise(F.lit(ROOT))
    nodes = stash(nodes.withColumn("parent", parent), "trie-nodes")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")

    children = nodes.groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = (nodes.select(F.col("name").alias("p"), F.col("conv_id").alias("parent_conv_id"))
               .union(root.select(F.lit(ROOT), "conv_id")))
    valued = (nodes.join(children, F.col("name") == F.col("of"), "left").join(parents, F.col("parent") == F.col("p"))
              .select("name", "way", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                      F.when(F.col("of").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
                      ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    columns = ["name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaves", "saved"]
    totals = _grafted(valued, deepest)
    # The root hangs above every problem: the totals of its children are its own.
    top = totals.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("below"), F.sum("saved").alias("saved"))
    root = (root.join(F.broadcast(top)).select(  # one row beside one row
        F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        "n_children", F.coalesce("below", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved")))

    last = places.select("conv_id", "depth", "name").join(
        convs.select(F.col("conv_id").alias("c"), "turns"), (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("turns")))
    ends = _end_lists(last.select("name", "conv_id").union(convs.where("turns = 0").select(F.lit(ROOT), "conv_id")))
    none = hashlib.sha256(b"").hexdigest()
    return (totals.select(columns).union(root.select(columns))
            .join(ends.withColumnRenamed("name", "ending"), F.col("name") == F.col("ending"), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
