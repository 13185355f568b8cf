"""SimHash near-duplicates: pigeonring candidates, then the full Hamming check.

Fingerprint: lower-cased (A-Z) words, runs of ``words`` words (repeats
count), XXH64 of each run with seed 42; a bit is set when it is set in more
than half of the hashes. A text without words has fingerprint zero and links
like any other.

Candidates: the 64 bits are a ring of four 16-bit segments. If two
fingerprints differ in at most 3 bits, then from some start on the ring every
chain of l = 1..4 consecutive segments differs in at most 3 * l / 4 bits, that
is in 0, 1, 2 and 3 bits (the strong form of the pigeonring principle). So
that start's segment is equal and the next one differs in at most one bit:

* each distinct fingerprint is listed under its four (start, 32 bits) keys,
* and asks under the same keys and their 16 neighbours that differ in one bit
  of the second segment.

The equi-join on these keys keeps a pair only under its first start whose
four chains all hold, the last of which is the full Hamming distance, so each
linked pair comes out once and none is lost. Keys of 32 bits keep random
meetings rare at any corpus size.

Copies of one fingerprint, however many, are one node: pairs are between
distinct fingerprints only.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import prepare, stash
from tidelake.llm.components import components
from tidelake.llm.rowkeys import keyed

WORDS = 3
MAX_BITS = 3
SEGMENTS = 4
SEGMENT_BITS = 16
#: Characters of a text whose words are listed at once.
_PIECE = 1 << 20
_SPACE = b" \t\n\v\f\r"


def _runs(text: bytes, words: int):
    """Lists of a text's word runs, piece by piece; a text of fewer words gives all its words as one run."""
    at, carry, any_run = 0, [], False
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        own = carry + text[at:end].lower().split()
        at = end
        if len(own) >= words:
            any_run = True
            yield list(map(b" ".join, zip(*(own[k:] for k in range(words)), strict=False)))
            carry = own[len(own) - words + 1:]
        else:
            carry = own
    if not any_run and carry:
        yield [b" ".join(carry)]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=42)
    total, ones = 0, np.zeros(64, np.int64)
    for runs in _runs(text, words):
        h = np.fromiter(map(digest, runs), np.uint64, len(runs))
        for k in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[k:k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                                  bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
                 row: Column | None = None) -> DataFrame:
    """doc_id, row, fingerprint (long) and text_hash (XXH64) of each row; null texts count as empty."""
    import xxhash

    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "row": batch.column("row"),
                "fingerprint": pa.array([fingerprint(t, words) for t in texts], pa.int64()),
                "text_hash": pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64), pa.int64())})

    row = F.lit(None).cast("long") if row is None else row
    return (docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, row long, fingerprint long, text_hash long"))


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * (k % SEGMENTS)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _mask(start: int, length: int) -> int:
    full = sum(((1 << SEGMENT_BITS) - 1) << SEGMENT_BITS * ((start + k) % SEGMENTS) for k in range(length))
    return full - (1 << 64) if full >= 1 << 63 else full


def _chains_hold(diff: Column, start: int) -> Column:
    """Whether every chain from ``start`` keeps to its share of the bits."""
    holds = F.lit(True)
    for length in range(1, SEGMENTS + 1):
        holds = holds & (F.bit_count(diff.bitwiseAND(F.lit(_mask(start, length)))) <= MAX_BITS * length // SEGMENTS)
    return holds


def _keys(fp: Column) -> list[Column]:
    return [F.shiftleft(F.lit(k).cast("long"), 2 * SEGMENT_BITS)
            .bitwiseOR(F.shiftleft(_segment(fp, k), SEGMENT_BITS)).bitwiseOR(_segment(fp, k + 1))
            for k in range(SEGMENTS)]


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of the nodes (id, fingerprint; fingerprints distinct)
    whose fingerprints differ in at most MAX_BITS bits."""
    fp = F.col("fingerprint")
    # A node becomes 72 rows: spread them before, however few files hold the nodes.
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    near = [F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)]]
    listed = nodes.select(F.col("id").alias("u"), fp.alias("fu"), F.explode(F.array(*_keys(fp))).alias("key"))
    asked = (nodes.select(F.col("id").alias("v"), fp.alias("fv"), F.explode(F.array(*_keys(fp))).alias("exact"))
             .select("v", "fv", F.explode(F.array(*near)).alias("bit"), "exact")
             .select("v", "fv", F.col("exact").bitwiseXOR(F.col("bit")).alias("key")))
    diff = F.col("fu").bitwiseXOR(F.col("fv"))
    start = F.shiftrightunsigned(F.col("key"), 2 * SEGMENT_BITS)
    first = F.coalesce(*[F.when(_chains_hold(diff, k), F.lit(k)) for k in range(SEGMENTS)])
    return (listed.join(asked, "key").where((F.col("u") < F.col("v")) & (first == start)).select("u", "v"))


def _components(prints: DataFrame, least: Column) -> DataFrame:
    """(fp, component, least) of each distinct fingerprint: the least fingerprint that it reaches, and the
    least of ``least`` over its rows. Fingerprints are the nodes, so that texts without an id link too."""
    classes = stash(prints.groupBy("fingerprint").agg(F.min(least).alias("least")), "fingerprint-classes")
    merged = components(links(classes.select(F.col("fingerprint").alias("id"), "fingerprint")))
    return classes.join(merged, classes["fingerprint"] == merged["node"], "left").select(
        F.col("fingerprint").alias("fp"), F.coalesce("component", "fingerprint").alias("component"), "least")


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and kept for each row.

    component_id is the smallest doc_id reachable over links; kept marks the
    row of that id (rows that repeat a doc_id within a component are all
    marked; texts that repeat one in other components belong to those). Null ids take part with
    their text, so links lead through them, but name no component: one
    without any id has a null component_id. Null and empty texts have
    fingerprint zero, texts of any length are hashed whole, further columns
    are ignored and an empty table gives no rows.
    """
    prints = stash(fingerprints(docs, words, id_col, text_col).select("doc_id", "fingerprint"), "fingerprints")
    classes = stash(_components(prints, F.col("doc_id")), "fingerprint-components")
    ids = classes.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    named = classes.join(ids, F.col("component") == F.col("c")).select("fp", "component_id")
    return (prints.join(named, F.col("fingerprint") == F.col("fp"), "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def deduplicated(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of linked fingerprints.

    The row with the least doc_id stays; where that id repeats within the
    group, the one of the least fingerprint, then text hash, then place in the
    table. An id that repeats with texts of different groups may stay more
    than once. Rows without an id cannot be named by a group and all stay,
    though links lead through them. Texts are not shuffled: the rows are
    numbered and written in blocks, and a bitmap for each block says which
    rows stay.
    """
    numbered = keyed(docs)
    prints = stash(fingerprints(numbered.table, words, id_col, text_col, row=F.col(numbered.row)), "fingerprints")
    classes = _components(prints, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "fingerprint", "text_hash", "row")))
    named = classes.groupBy("component").agg(F.min("least").alias("least")).where("least is not null").select("least.row")
    return numbered.only(named.union(prints.where("doc_id is null").select("row")))
