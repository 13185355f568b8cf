"""Key tables of raw and events that are stored alike, so that they meet without an exchange.

Each table's keys (uuid, event date, load time and grouping columns, no
payload) are kept beside it in a table partitioned by event date and bucketed
and sorted by uuid, in the same number of buckets. A load appends the keys of
its rows, dealt by uuid once; finding the rows of one table that the other one
lacks is then a merge join of buckets, however often it is asked. Days that
``since`` leaves out are not read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidelake.functions as W
from tidelake.operators.maintenance import lag_of

BUCKETS = 64
#: The uuid, or for rows without one a key of their own.
KEY = "uuid_key"


def raw_keys(raw: DataFrame, by: list[str]) -> DataFrame:
    return raw.select(W.json_path("raw_json", "$.uuid", "string").alias("uuid"), *by, "insertion_timestamp", "event_date")


def event_keys(events: DataFrame) -> DataFrame:
    return events.select("uuid", "event_date")


def append_keys(keys: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Add keys to the key table ``table`` (made at ``path`` when it is new): one file for each bucket and
    day that the batch holds, since rows are dealt as buckets are. Rows without a uuid match nothing; a key
    that no uuid has spreads them over the buckets."""
    spark = keys.sparkSession
    lone = F.concat(F.lit("\u0000"), F.rand(0).cast("string"))
    dealt = keys.withColumn(KEY, F.coalesce("uuid", lone)).repartition(buckets, KEY)
    writer = dealt.write.mode("append").format("parquet").partitionBy("event_date").bucketBy(buckets, KEY).sortBy(KEY)
    if not spark.catalog.tableExists(table):
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def copartitioned_lag(spark: SparkSession, raw_table: str, events_table: str, as_of: Column | None = None,
                      by: list[str] | None = None, since: dt.date | None = None) -> DataFrame:
    """:func:`maintenance.transform_lag` over two key tables: pending rows by a merge join of their buckets."""
    by = by or []
    raw, events = spark.table(raw_table), spark.table(events_table)
    if since is not None:
        recent = F.coalesce(F.col("event_date") >= F.lit(since), F.lit(True))
        raw, events = raw.where(recent), events.where(recent)
    # distinct within a bucket: the buckets are dealt by uuid, so nothing moves
    consumed = events.where(F.col("uuid").isNotNull()).select(KEY).distinct().withColumn("_consumed", F.lit(True))
    return lag_of(raw.hint("merge").join(consumed, KEY, "left"), by, as_of)
