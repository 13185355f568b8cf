"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Rows of equal label and equal vector are one class with a number of copies,
so a vector that fills a large share of the table is compared once.

Hashing: a table's key is K values floor((a . v + b) / WIDTH) of the
normalised vector v, with a Gaussian and b uniform. Vectors at the least
cosine share one value with probability p1, unrelated ones (orthogonal) with
p2. K is such that a class meets about COLLISIONS unrelated classes of the
largest label in a bucket, and the number of tables such that a pair at the
least cosine shares no bucket with probability MISS at most; both follow from
the number of classes, without a cap. Pairs of higher cosine are missed less.

Comparing: keys that only one class holds are dropped. Classes of the other
buckets are sorted by bucket and compared as matrices. A bucket of more than
``block`` classes is dealt into slots by a hash, and each pair of slots is
compared by itself, so no task holds more than about two blocks and no pair is
left out. A pair counts in the first table in which its keys agree. What leaves
a block is each class's number of links and a star for each of the block's
components: never the pairs.

Cosines are exact, in double precision, on the original vectors. Rows whose
label is null, whose id is null, or whose vector is null, zero or holding null
or non-finite components link with nothing (n_links 0, their own component);
vectors of differing length never link. Repeated ids of one vector count as
copies. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import vectors
from tidelake.llm.common import prepare, stash
from tidelake.llm.components import components

LEAST = 0.93
WIDTH = 2.5
COLLISIONS = 0.25
MISS = 0.02
BLOCK = 512
SEED = 11
#: Rounding that candidate cosines of normalised vectors may carry before the exact check.
_SLACK = 1e-6


def agreement(distance: float, width: float = WIDTH) -> float:
    """The probability that two points at ``distance`` share one quantised Gaussian projection."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def sizes(n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """Projections of a key and number of tables for labels of up to ``n`` classes."""
    p1, p2 = agreement(math.sqrt(2 - 2 * least)), agreement(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2) / COLLISIONS) / -math.log(p2)))
    return k, math.ceil(math.log(miss) / math.log(1 - p1**k))


@functools.lru_cache(maxsize=8)
def _projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Gaussian directions, offsets and hash factors of all keys."""
    rng = np.random.default_rng([SEED, dim])
    return (rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables),
            rng.integers(1 << 62, size=(k * tables)).astype(np.uint64) | np.uint64(1))


def keys_of(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The 64-bit bucket key of each row in each table."""
    directions, offsets, mix = _projections(x.shape[1], k, tables)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    cell = np.floor((unit @ directions + offsets) / WIDTH)
    with np.errstate(over="ignore"):
        h = (cell.astype(np.int64).astype(np.uint64) * mix).reshape(len(x), tables, k).sum(2, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose exact cosine reaches ``least``."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    i, j = np.nonzero((a / na[:, None]) @ (b / nb[:, None]).T >= least - _SLACK)
    sure = np.empty(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        p, q = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
        sure[s:s + (1 << 16)] = (a[p] * b[q]).sum(1) / (na[p] * nb[q]) >= least
    return i[sure], j[sure]


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n members' components."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare(table: int, alone: bool, side: np.ndarray, cid: np.ndarray, copies: np.ndarray, x: np.ndarray, least: float,
             k: int, tables: int):
    """One block: (class, links to add, root) of the classes that link here. side 0 and 1 are the two
    slots of a pair; a block of one slot ``alone`` compares it with itself."""
    a = np.flatnonzero(side == 0)
    b = a if alone else np.flatnonzero(side == 1)
    i, j = linked(x[a], x[b], least)
    i, j = a[i], b[j]
    if alone:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return
    # Keys are worked out again for the few that link, which is cheaper than carrying them along.
    met = np.unique(np.concatenate([i, j]))
    keys = np.empty((len(cid), tables), np.int64)
    keys[met] = keys_of(x[met], k, tables)
    own = np.empty(len(i), bool)
    for s in range(0, len(i), 1 << 14):
        p, q = i[s:s + (1 << 14)], j[s:s + (1 << 14)]
        own[s:s + (1 << 14)] = (keys[p] == keys[q]).argmax(1) == table
    i, j = i[own], j[own]
    if not len(i):
        return
    links = np.zeros(len(cid), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root = stars(len(cid), i, j)
    at = np.flatnonzero(links)
    yield from zip(cid[at].tolist(), links[at].tolist(), cid[root[at]].tolist(), strict=True)


_GROUP = ["label", "dim", "tab", "key", "low", "high"]


def near_duplicates(embeddings: DataFrame, least: float = LEAST, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of each row."""
    prepare(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "label", "embedding")
    takes_part = vectors.valid("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = stash(rows.where(takes_part).groupBy("label", "embedding")
                    .agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("copies"))
                    .withColumn("dim", F.size("embedding")), "vector-classes")
    n = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    k, tables = sizes(n, least, miss)

    def sign(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                keys = keys_of(vectors.matrix(own.column("embedding")), k, tables)
                yield pa.RecordBatch.from_pydict({**{c: own.column(c) for c in ("label", "dim", "cid")},
                                                  "keys": pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))})

    kinds = dict(classes.dtypes)
    signed = stash(classes.select("label", "dim", "cid", "embedding").mapInArrow(
        sign, f"label {kinds['label']}, dim int, cid {kinds['cid']}, keys array<long>"), "vector-keys")
    buckets = signed.select("label", "dim", "cid", F.posexplode("keys").alias("tab", "key"))
    full = (buckets.groupBy("label", "dim", "tab", "key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
            .withColumn("slots", F.ceil(F.col("held") / F.lit(block)).cast("int")))
    slot = F.pmod(F.xxhash64("cid", "tab"), F.col("slots")).cast("int")
    dealt = (buckets.join(full, ["label", "dim", "tab", "key"])
             .withColumn("slot", slot).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
             .select("label", "dim", "tab", "key", "cid", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"),
                     (F.col("slot") > F.col("other")).cast("int").alias("side")))
    loaded = dealt.join(classes.select(F.col("cid").alias("own_cid"), F.col("label").alias("own_label"), F.col("dim").alias("own_dim"),
                                       "embedding", "copies"),
                        (F.col("cid") == F.col("own_cid")) & (F.col("label") == F.col("own_label")) & (F.col("dim") == F.col("own_dim"))) \
        .drop("own_cid", "own_label", "own_dim")

    def compare(batches):
        held: list = []
        now, out = None, []

        def close():
            return _compare(now[2], now[4] == now[5], *(np.concatenate([h[c] for h in held]) for c in range(4)), least, k, tables)

        for batch in batches:
            group = list(zip(*(batch.column(c).to_pylist() for c in _GROUP), strict=True))
            side, cid, copies = (batch.column(c).to_numpy() for c in ("side", "cid", "copies"))
            cuts = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if group[a] != now:
                    if held:
                        out += close()
                    held, now = [], group[a]
                own = batch.slice(a, b - a)
                held.append((side[a:b], cid[a:b], copies[a:b], vectors.matrix(own.column("embedding"))))
            if len(out) > 10_000:
                yield rows_of(out)
                out = []
        if held:
            out += close()
        if out:
            yield rows_of(out)

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["cid", "links", "root"])

    found = stash(loaded.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(compare, "cid long, links long, root long"), "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    merged = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    known = (classes.select("label", "embedding", "cid", "copies").join(links, "cid", "left")
             .join(merged, F.col("cid") == F.col("node"), "left")
             .select(F.col("label").alias("l"), F.col("embedding").alias("e"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")))
    # Rows that take no part are kept out of the join: their null keys would meet in one task.
    inside = rows.where(takes_part).join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left") \
        .select("vec_id", "n_links", "component_id")
    outside = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.union(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
