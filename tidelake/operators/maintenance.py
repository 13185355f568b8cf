"""Events-table maintenance: metadata back-fill (W10), transform lag (W6,
W12) and reduced-column views (K13)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidelake.functions as W
from tidelake.operators.events import EVENTS_SCHEMA
from tidelake.operators.keyfilter import key_filter, may_match
from tidelake.streaming.publish import Publication, new_batch, work_root, writer
from tidelake.util import list_files

VIEW_COMMENT = "Load time, cell and organisation only; payload columns are left out"
EVENTS_VIEW_COLUMNS = ["insertion_timestamp", "cell", "uuid", "org_id"]
RAW_VIEW_COLUMNS = ["insertion_timestamp", "cell", "org_id"]


def metadata_objects(raw: DataFrame) -> DataFrame:
    """``raw_json:metadata::object`` of every record whose metadata is an
    object (P6, J7): legacy array-shaped values are left out."""
    meta = W.json_path("raw_json", "$.metadata")
    return (raw.where(meta.isNotNull() & W.is_object(meta))
            .select(W.json_path("raw_json", "$.uuid", "string").alias("uuid"), W.as_object(meta).alias("metadata"),
                    "insertion_timestamp", "event_date"))


def metadata_fill(raw: DataFrame) -> DataFrame:
    """One fill per event (event_date, uuid): the metadata of the record
    loaded last, by text order when load times tie."""
    return _last_loaded(metadata_objects(raw).where(F.col("uuid").isNotNull()), ["event_date", "uuid"])


def _last_loaded(records: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.struct("insertion_timestamp", F.to_json("metadata"))
    return records.groupBy(*keys).agg(F.max_by("metadata", rank).alias("metadata"))


def backfill_metadata(events: DataFrame, raw: DataFrame, mode: str = "keyed") -> DataFrame:
    """The events table with ``metadata`` filled from the raw records.

    ``keyed`` (default) updates each event from its own record: events
    without metadata meet one fill row per (event_date, uuid); the others,
    and events without a uuid, go around the join.  ``append`` reproduces
    the literal statement, which adds rows holding only ``metadata`` (Q1).
    """
    if mode == "append":
        extra = metadata_objects(raw).select(*[
            F.col("metadata") if c == "metadata" else F.lit(None).cast(events.schema[c].dataType).alias(c)
            for c in events.columns])
        return events.unionByName(extra)
    if mode != "keyed":
        raise ValueError(f"mode must be 'keyed' or 'append', not {mode!r}")
    return _filled(events, metadata_fill(raw))


def _filled(events: DataFrame, fill: DataFrame) -> DataFrame:
    waits = F.col("metadata").isNull() & F.col("uuid").isNotNull()
    e, f = events.where(waits).alias("e"), fill.hint("merge").alias("f")  # one row an event: nothing to broadcast
    joined = e.join(f, (F.col("e.uuid") == F.col("f.uuid")) & F.col("e.event_date").eqNullSafe(F.col("f.event_date")), "left")
    filled = joined.select(*[F.col(f"f.{c}" if c == "metadata" else f"e.{c}").alias(c) for c in events.columns])
    return filled.unionByName(events.where(~waits))


def due_fill(events: DataFrame, raw: DataFrame, staged: str) -> DataFrame:
    """The fills (event_date, uuid, metadata) that stored events wait for, written to ``staged`` and read back.

    The keys in need are summarised first: their dates prune the raw table's
    partitions, a filter of bounded size (``keyfilter``) drops raw records of
    other keys before anything is shuffled. What passes is grouped, and joined
    exactly to the keys in need, by a merge join: Spark guesses the size of a
    few columns of a table of VARIANTs far too low, and would send the keys
    through the driver.
    """
    spark = events.sparkSession
    need = events.where(F.col("metadata").isNull() & F.col("uuid").isNotNull()).select("event_date", "uuid")
    days = [r[0] for r in need.select("event_date").distinct().collect()]  # dates, not rows
    wanted = key_filter(need, ["uuid"])
    records = may_match(metadata_objects(raw.where(_on_days(days))).where(F.col("uuid").isNotNull()), ["uuid"], wanted)
    # Dates without their null, so that the group-by and the join share one exchange of the metadata.
    dated = [F.coalesce("event_date", F.lit(dt.date(1970, 1, 1))).alias("day"), F.col("event_date").isNull().alias("dateless")]
    fill = (_last_loaded(records.withColumns({"day": dated[0], "dateless": dated[1]}), ["day", "dateless", "uuid"])
            .join(need.select(*dated, "uuid").hint("merge"), ["day", "dateless", "uuid"], "left_semi")
            .select(F.when(~F.col("dateless"), F.col("day")).alias("event_date"), "uuid", "metadata"))
    fill.write.parquet(staged)
    return spark.read.schema(fill.schema).parquet(staged)


def _on_days(days: list[dt.date | None]) -> Column:
    return F.col("event_date").isin([d for d in days if d]) | (F.lit(None in days) & F.col("event_date").isNull())


def write_backfill(spark: SparkSession, events_path: str, raw: DataFrame, wait: float = 3600.0) -> int:
    """Fill the stored events table (keyed) and return the partitions
    rewritten: those that hold an event which gets metadata.  The new files
    and the removal of the old ones are one publication; the fill is made
    once (:func:`due_fill`) and read by both steps."""
    schema = f"{EVENTS_SCHEMA}, load_part STRING"
    root = work_root(events_path)
    with writer(spark, root, wait):
        events = spark.read.schema(schema).parquet(events_path)
        new = Publication(spark, root, new_batch("backfill"))
        fill = due_fill(events, raw, new.stage("_fill"))
        days = [r[0] for r in fill.select("event_date").distinct().collect()]  # dates, not rows
        if not days:
            new.discard()
            return 0
        folders = [f"event_date={d.isoformat() if d else '__HIVE_DEFAULT_PARTITION__'}" for d in days]
        _filled(events.where(_on_days(days)), fill).write.partitionBy("event_date").parquet(new.stage("events"))
        new.commit({"events": events_path},
                   [f"{events_path}/{d}/{f}" for d in folders for f in list_files(spark, f"{events_path}/{d}", ".parquet")])
        return len(days)


def transform_lag(raw: DataFrame, events: DataFrame, as_of: Column | None = None,
                  by: list[str] | None = None, since: dt.date | None = None) -> DataFrame:
    """Minutes the raw -> events copy lags behind (W6), per group.

    Pending rows are raw rows whose ``uuid`` is not in events (one left
    join on the event key, then a partially aggregated groupBy); rows
    without a uuid can match nothing and go around the join.  ``since``
    prunes both tables to event dates from there on, when older ones are
    known to be consumed.  The stream's offset time (W12) is the latest load
    time already consumed; with nothing consumed yet, the earliest pending
    load time.  The lag is 0 with nothing pending, else the minute
    boundaries from the offset to ``as_of`` (default: now in UTC), as DOUBLE.
    """
    by = by or []
    if since is not None:
        recent = F.coalesce(F.col("event_date") >= F.lit(since), F.lit(True))
        raw, events = raw.where(recent), events.where(recent)
    consumed = events.select("uuid").distinct().withColumn("_consumed", F.lit(True))
    r = raw.select(*by, "insertion_timestamp", W.json_path("raw_json", "$.uuid", "string").alias("uuid"))
    j = r.where(F.col("uuid").isNotNull()).join(consumed, "uuid", "left") \
        .unionByName(r.where(F.col("uuid").isNull()).withColumn("_consumed", F.lit(None).cast("boolean")))
    return lag_of(j, by, as_of)


def lag_of(rows: DataFrame, by: list[str], as_of: Column | None = None) -> DataFrame:
    """Pending rows, offset time and lag of raw rows (``by``, insertion_timestamp, _consumed: true or null)."""
    as_of = W.utc_now() if as_of is None else as_of
    pending = F.col("_consumed").isNull()
    agg = rows.groupBy(*by).agg(
        F.count(F.when(pending, 1)).alias("pending_rows"),
        F.max(F.when(~pending, F.col("insertion_timestamp"))).alias("last_consumed"),
        F.min(F.when(pending, F.col("insertion_timestamp"))).alias("first_pending"),
    )
    offset = F.coalesce("last_consumed", "first_pending")
    return agg.select(
        *by, "pending_rows", offset.alias("offset_time"),
        F.when(F.col("pending_rows") > 0, W.datediff_minutes(offset, as_of).cast("double"))
         .otherwise(F.lit(0.0)).alias("lag_minutes"))


def create_reduced_view(spark: SparkSession, table: str, columns: list[str], view: str) -> str:
    """One minimal-column view with the non-privileged comment."""
    spark.sql(f"CREATE OR REPLACE VIEW {view} COMMENT '{VIEW_COMMENT}' AS "
              f"SELECT {', '.join(columns)} FROM {table}")
    return view


def create_reduced_views(spark: SparkSession, events_table: str, raw_table: str, schema: str) -> tuple[str, str]:
    """Minimal-column views over the events and raw tables (K13); the
    schema must exist."""
    return (create_reduced_view(spark, events_table, EVENTS_VIEW_COLUMNS, f"{schema}.non_privileged_events"),
            create_reduced_view(spark, raw_table, RAW_VIEW_COLUMNS, f"{schema}.non_privileged_raw_events"))


def save_external_table(df: DataFrame, name: str, location: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` as parquet at ``location`` and register it as ``name``."""
    writer = df.write.mode("overwrite").format("parquet").option("path", location)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


__all__ = ["backfill_metadata", "due_fill", "metadata_fill", "metadata_objects", "write_backfill", "transform_lag", "create_reduced_view", "create_reduced_views",
           "save_external_table"]
