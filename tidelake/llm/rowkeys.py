"""Keeping some rows of a table without shuffling the table.

``keyed`` writes a table once with a number for each row, bucketed by blocks
of BLOCK_ROWS row numbers. ``only`` takes the numbers of the rows to keep,
makes one bitmap (a bit for each row) of each block and joins it to the
block's rows: the written table is read by its buckets, so only the bitmaps
move.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import stash
from tidelake.session import run_dir

#: Bits of one of Spark's bitmaps.
BLOCK_ROWS = 8 * 4096


@dataclass(frozen=True)
class Keyed:
    table: DataFrame
    columns: list[str]
    row: str = "__row"
    block: str = "__block"

    def only(self, rows: DataFrame) -> DataFrame:
        """The table's rows (its own columns) whose numbers are in the one column of ``rows``."""
        number = F.col(rows.columns[0])
        bits = stash(rows.select(F.floor(number / F.lit(BLOCK_ROWS)).cast("long").alias("__of"), (number % BLOCK_ROWS).alias("bit"))
                     .groupBy("__of").agg(F.bitmap_construct_agg("bit").alias("__bits")), "kept-rows")
        place = f"{self.row} % {BLOCK_ROWS}"
        byte = f"cast(conv(hex(substring(__bits, cast(({place}) div 8 as int) + 1, 1)), 16, 10) as int)"
        return (self.table.join(bits, F.col(self.block) == F.col("__of"))
                .where(F.expr(f"getbit({byte}, cast(({place}) % 8 as int)) = 1")).select(*[F.col(f"`{c}`") for c in self.columns]))


def keyed(df: DataFrame) -> Keyed:
    spark = df.sparkSession
    row = F.monotonically_increasing_id()
    name = f"tidelake_rows_{uuid.uuid4().hex[:12]}"
    out = Keyed(df, df.columns)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.withColumn(out.row, row).withColumn(out.block, F.shiftright(F.col(out.row), BLOCK_ROWS.bit_length() - 1))
     .write.bucketBy(buckets, out.block).format("parquet").option("path", run_dir(spark, "rows")).saveAsTable(name))
    return Keyed(spark.table(name), df.columns)
