"""Row numbers inside ordered groups, however large a group is.

Rows are range-partitioned by group and order, sorted and written with their
number inside their part of the group; a group that runs on from an earlier
partition adds what lies before. So a group that holds a third of all rows is
spread over a third of the partitions, and no task holds a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import stash

#: Characters of a text that decide between rows of equal order before a digest does.
HEAD = 32
#: The columns that put the turns of a conversation in order.
TURN_ORDER = ["turn", "role", "head", "d1", "d2"]


def word_count(text: Column) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def digest(*cols: Column) -> list[Column]:
    """128 bits (d1, d2) of the MD5 of some texts, each preceded by its length."""
    parts = [p for c in cols for p in (F.octet_length(c).cast("string"), F.lit(":"), c)]
    hexed = F.md5(F.concat(*parts).cast("binary"))
    return [F.conv(F.substring(hexed, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "d1"), (17, "d2"))]


def turn_keys() -> list[Column]:
    """The order of a conversation's rows (columns turn, role, text without null texts):
    turn, null first; ties by role, then by the text's first HEAD characters, then by digest.
    Rows equal in all of these are repeated rows, whose order does not show."""
    return ["turn", "role", F.substring("text", 1, HEAD).alias("head"), *digest(F.col("role"), F.col("text"))]


def _changed(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first one counts as no change."""
    if len(column) < 2:
        return np.zeros(len(column), bool)
    left, right = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(left, right), False), pc.and_(pc.is_null(left), pc.is_null(right)))
    return np.concatenate([[False], ~same.to_numpy(zero_copy_only=False)])


def numbered(df: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """The rows of ``df`` with ``at``, their place (from 1) in their group; written to the
    shared folder. A null group is a group of its own.

    The rows are written before they are dealt too: the range exchange reads its input twice
    (its bounds come from a sample), and so does not work out keys from the texts twice.
    """
    df = stash(df, f"{what}-keys")

    def run(batches):
        part = TaskContext.get().partitionId()
        last, run_before, idx = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(group)
            goes_on = idx > 0 and keys[0].as_py() == last
            starts = np.flatnonzero(_changed(keys))
            begin = np.zeros(n, np.int64)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            at = np.arange(n) - begin + 1
            if goes_on:
                at[:starts[0] if len(starts) else n] += run_before
            last, run_before = keys[n - 1].as_py(), int(at[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int64()), pa.array(np.full(n, part), pa.int64()),
                 pa.array(np.arange(idx, idx + n), pa.int64())],
                names=[*batch.schema.names, "run", "part", "idx"])
            idx += n

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    rows = stash(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                 .mapInArrow(run, f"{fields}, run long, part long, idx long"), what)
    # One row for each partition of the range exchange.
    parts = rows.groupBy("part").agg(F.min_by(group, "idx").alias("first"), F.max_by(group, "idx").alias("last"),
                                     F.max_by("run", "idx").alias("n_last"))
    in_order = Window.orderBy("part")
    so_far = Window.partitionBy("last").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (parts.withColumn("held", F.sum("n_last").over(so_far))
               .withColumn("before", F.when(F.lag("last").over(in_order).eqNullSafe(F.col("first")) & (F.lag("part").over(in_order).isNotNull()),
                                            F.lag("held").over(in_order)))
               .where("before > 0").select(F.col("part").alias("_part"), F.col("first").alias("_first"), "before"))
    return (rows.join(F.broadcast(offsets), (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_first")), "left")
            .select(*df.columns, (F.col("run") + F.coalesce("before", F.lit(0))).alias("at")))
