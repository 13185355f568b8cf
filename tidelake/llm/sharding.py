"""Contiguous shards of near-equal size from global prefix sums. DataFrame functions only.

The global order is (hash of the text, doc_id, rank key), so equal texts are
neighbours and any group of copies may still spread over partitions and
shards. Steps:

1. One scan of the texts writes a narrow table (id, size, checksum, hash).
2. That table is range-partitioned by the order and written again with its
   partition number: the boundaries are then fixed, whatever is repeated later.
3. Bytes and rows of each partition are summed (partly aggregated); a running
   sum over these totals, one row for each partition, gives each partition's
   global start.
4. Inside each partition a running sum gives every row's global byte range.
   A row belongs to the shard in whose equal share of all bytes its middle
   lies, so shards are contiguous and differ by at most one row's size at
   each cut.
5. A row's slot is its global row number less that of its shard's first row.

Null texts count as empty (size 1), texts of any length are measured where they
are read and never move, further columns are ignored, repeated rows are rows of their own, ties
in the order are broken by size and checksum, an empty table gives an empty
result, and shards may be empty when there are fewer rows than shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import prepare, stash

SHARDS = 16


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stash(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "shard-sizes")
    order = ["h", "doc_id", "size", "text_crc32"]
    ranged = stash(narrow.repartitionByRange(*order)
                   .withColumn("part", F.spark_partition_id()), "shard-ranges")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("all_bytes"))

    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # starts has one row for each partition of the range exchange
    placed = (ranged
              .withColumn("end_in_part", F.sum("size").over(within))
              .withColumn("row_in_part", F.count(F.lit(1)).over(within))
              .join(F.broadcast(starts), "part")
              .withColumn("row", F.col("rows_before") + F.col("row_in_part") - 1)
              .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("end_in_part")) - F.col("size"))
              .withColumn("shard", F.expr(f"cast((twice_middle * {shards}) div (2 * all_bytes) as int)"))
              .select("doc_id", "size", "text_crc32", "shard", "row"))
    placed = stash(placed, "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
