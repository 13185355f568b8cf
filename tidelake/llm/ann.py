"""Approximate nearest neighbours by a hash-prefix forest.

A tree gives every vector a string of BITS bits, the sides of as many random
hyperplanes through the mean of all vectors, and is the sorted array of these
strings; vectors that share a longer prefix with a query are likelier to be
near. All rows are dealt by a hash of id and vector into segments of bounded size,
each with its own sorted arrays, so neither a group of copies nor a dense
region gathers in one task, and vectors are not copied for each tree. Queries
go to every segment.

Round 1 (descent): in every segment and tree a query descends by binary
search to its longest matching prefixes, then all trees ascend together, one
bit a step, until they hold at least ``first`` candidates. Their exact
distances give the 10 nearest so far over all segments.

Round 2 (synchronous ascent): two vectors at angle t (seen from the mean)
agree in a bit with probability 1 - t / pi. For the widest angle among the
nearest so far this gives the prefix length at which at most a share MISS of
such neighbours would be missed by all trees; all trees of all segments
ascend to it, however many candidates that brings. Queries with fewer than
the wanted neighbours so far ascend to the root and see every row.

Distances are exact, in double precision, on the original vectors; ties go to
the smaller id. Rows whose vector is null, zero, of another length than most
or holding null or non-finite components take no part, nor do rows without an
id. Repeated ids are rows of their own, as queries and as candidates (a query
never finds its own row, but may find another one of its id).
An empty table, or one row, gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm import vectors
from tidelake.llm.common import prepare, stash

TREES = 32
BITS = 32
SEGMENT_ROWS = 8192
FIRST = 640
MISS = 0.1
SEED = 7


def planes(dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, TREES * BITS))


def codes(x: np.ndarray, centre: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """The bit strings of each row in each tree, as numbers."""
    side = ((x - centre) @ normals > 0).reshape(len(x), TREES, BITS)
    return side.astype(np.uint64) @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))


class Forest:
    """One segment's sorted arrays."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, normals: np.ndarray):
        self.rows, self.ids, self.x, self.centre, self.normals = rows, ids, x, centre, normals
        c = codes(x, centre, normals)
        self.order = np.argsort(c, axis=0, kind="stable")
        self.sorted = np.take_along_axis(c, self.order, axis=0)

    def _ranges(self, q: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For query codes (queries, trees) the array ranges that share ``levels`` leading bits
        (levels: one for each query, or a column of levels for all)."""
        rest = (np.uint64(1) << (BITS - levels).astype(np.uint64)) - np.uint64(1)
        low, high = [], []
        for t in range(TREES):
            at = q[:, t] & ~rest
            low.append(np.searchsorted(self.sorted[:, t], at, "left"))
            high.append(np.searchsorted(self.sorted[:, t], at | rest, "right"))
        return np.stack(low), np.stack(high)

    def search(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, levels: np.ndarray | None, k: int, first: int):
        """(query row, query id, row, id, distance, angle) of each query's k nearest candidates. levels: the common
        prefix length of each query, or None to ascend until ``first`` candidates are met."""
        q = codes(x, self.centre, self.normals)
        if levels is None:
            down = np.arange(BITS, -1, -1)[:, None]
            low, high = self._ranges(q, down)  # (trees, levels, queries)
            met = (high - low).sum(0) >= min(first, len(self.ids))
            levels = BITS - met.argmax(0)
        low, high = self._ranges(q, levels)
        seen = np.zeros(len(self.ids), bool)
        for i in range(len(ids)):
            seen[:] = False
            if levels[i] == 0:
                seen[:] = True
            else:
                for t in range(TREES):
                    seen[self.order[low[t, i]:high[t, i], t]] = True
            at = np.flatnonzero(seen & (self.rows != rows[i]))
            if not len(at):
                continue
            d = np.sqrt(((self.x[at] - x[i]) ** 2).sum(1))
            if len(at) > k:
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                at, d = at[near], d[near]
            by = np.lexsort((self.rows[at], self.ids[at], d))[:k]
            at, d = at[by], d[by]
            a, b = x[i] - self.centre, self.x[at] - self.centre
            size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1))
            angle = np.arccos(np.clip((b @ a) / np.where(size > 0, size, 1), -1, 1))
            yield from zip([rows[i]] * len(at), [ids[i]] * len(at), self.rows[at].tolist(), self.ids[at].tolist(), d.tolist(), angle.tolist(), strict=True)


def _round(rows: DataFrame, queries: DataFrame, segments: int, dim: int, centre: np.ndarray, k: int, first: int) -> DataFrame:
    """The k nearest that each segment holds for each query. queries: row, vec_id, embedding, level (null: first round)."""
    both = (rows.select("row", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(segments)).cast("int").alias("segment"),
                        F.lit(0).alias("kind"), F.lit(None).cast("int").alias("level"))
            .union(queries.select("row", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"),
                                  F.lit(1).alias("kind"), "level")))

    def run(batches):
        normals = planes(dim)
        own, held, forest = None, [], None
        found: list = []
        for batch in batches:
            seg, kind = batch.column("segment").to_numpy(), batch.column("kind").to_numpy()
            nums, ids, x = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), vectors.matrix(batch.column("embedding"))
            level = batch.column("level").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(seg) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(seg)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if seg[a] != own:
                    own, held, forest = seg[a], [], None
                if kind[a] == 0:
                    held.append((nums[a:b], ids[a:b], x[a:b]))
                    continue
                if forest is None and held:
                    forest = Forest(*(np.concatenate([h[n] for h in held]) for n in range(3)), centre, normals)
                    held = []
                if forest is not None:
                    own_level = None if np.isnan(level[a].astype(float)) else level[a:b].astype(np.int64)
                    found += forest.search(nums[a:b], ids[a:b], x[a:b], own_level, k, first)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(),) * 4 + (pa.float64(),) * 2, strict=True)],
                                                 ["query_row", "query_id", "row", "vec_id", "score", "angle"])
                found = []

    nearest = (both.repartition(segments, "segment").sortWithinPartitions("segment", "kind")
               .mapInArrow(run, "query_row long, query_id long, row long, vec_id long, score double, angle double"))
    return _top(nearest, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest; segments hand in at most k rows a query."""
    by = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest_neighbours(embeddings: DataFrame, is_query, k: int = 10, first: int = FIRST, miss: float = MISS,
                       segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest
    found. ``is_query``: a condition on embeddings' rows; every row is a candidate."""
    spark = embeddings.sparkSession
    prepare(spark)
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")) \
        .where(vectors.valid("embedding") & F.col("vec_id").isNotNull())
    lengths = usable.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths
    rows = stash(usable.where(F.size("embedding") == dim).withColumn("row", F.monotonically_increasing_id()), "ann-rows")

    def sums(batches):
        total = np.zeros(dim)
        for batch in batches:
            total += vectors.matrix(batch.column("embedding")).sum(0) if batch.num_rows else 0
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dim), pa.int64()), "total": total})

    added = rows.select("embedding").mapInArrow(sums, "at long, total double").groupBy("at").agg(F.sum("total")).collect()
    centre = np.round(np.array([t for _, t in sorted(added)]) / n, 6)  # dim rows; rounded, as sums differ by their order
    segments = max(1, -(-n // segment_rows))
    queries = rows.where("asks").select("row", "vec_id", "embedding")

    near = stash(_round(rows, queries.withColumn("level", F.lit(None).cast("int")), segments, dim, centre, k, first), "ann-first")
    # The prefix length at which all trees miss a neighbour at the widest angle with probability ``miss`` at most.
    needed = math.log(1 - miss ** (1 / TREES))
    agree = 1 - F.least(F.col("widest"), F.lit(math.pi * 0.999)) / math.pi
    level = (F.when(F.coalesce("met", F.lit(0)) < k, 0)
             .otherwise(F.least(F.lit(BITS), F.floor(needed / F.log(F.least(agree, F.lit(1 - 1e-9))))))).cast("int")
    so_far = near.groupBy("query_row").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("met"))
    again = (queries.join(so_far, queries["row"] == so_far["query_row"], "left")
             .select("row", "vec_id", "embedding", level.alias("level")))
    best = _round(rows, again, segments, dim, centre, k, first)
    found = best.drop("rank").union(near.drop("rank")).dropDuplicates(["query_row", "row"])
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
