"""Incremental loading with Structured Streaming.

Two streams, each a ``readStream -> transform -> foreachBatch`` query with
its own checkpoint and a bounded trigger:

* landing file names -> raw events (the pipe).  The stream tracks which
  files are new (names only); each micro-batch goes through
  :func:`load_files`, which loads the files that the load ledger does not
  list yet.
* raw events -> typed events (the copy task).  Each micro-batch goes
  through :func:`append_events`, which decomposes the rows of load parts
  that the consumed ledger does not list yet.

A load part is what one task loaded: every raw row carries its
``load_part``, so consumption is known per (load_part, event_date) whatever
file the row is stored in.  A retention trim that rewrites a raw file
therefore neither hides nor repeats a row.

Rows and ledger entries of a batch are staged and published together
(:mod:`tidelake.streaming.publish`), under the table's writer lock: a crash
at any point leaves either nothing or everything, and a refresh that
overlaps a running load waits for it.

``trigger(availableNow=True)`` is the "has new data" gate (W2): a run with
nothing new processes zero rows and returns.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelake.functions.dialect import register
from tidelake.operators.events import EVENTS_SCHEMA, decompose, only_inserts
from tidelake.operators.keyfilter import groups_that_may_hold, key_filter
from tidelake.sources.landing import RAW_SCHEMA, enrich, read_records
from tidelake.streaming.publish import Publication, new_batch, work_root, writer
from tidelake.util import list_dirs, list_files, path_exists

FILES_SUFFIX = "_loaded_files"
FILTER_SUFFIX = "_loaded_files_filter"
PARTS_SUFFIX = "_loaded_parts"
CONSUMED_SUFFIX = "_consumed_parts"

# One row per landing file, per load part and event date, and per consumed one.
FILES_SCHEMA = "source_file STRING, batch STRING, load_day DATE"
FILTER_SCHEMA = "filter_block INT, filter_bits BINARY, load_day DATE"
#: Bitmaps of a ledger day's filter: 1 MiB when all are full, for some hundred thousand files a day.
FILTER_BLOCKS = 256
PARTS_SCHEMA = "load_part STRING, event_date DATE, n_rows BIGINT, insertion_timestamp TIMESTAMP_NTZ, load_day DATE"
PART_KEYS = ["load_part", "event_date"]


def files_path(raw_path: str) -> str:
    """Ledger of landing files the raw table has loaded."""
    return raw_path.rstrip("/") + FILES_SUFFIX


def filter_path(raw_path: str) -> str:
    """Filters of the file ledger's names, by ledger day (``keyfilter``)."""
    return raw_path.rstrip("/") + FILTER_SUFFIX


def parts_path(raw_path: str) -> str:
    """Ledger of load parts the raw table has received."""
    return raw_path.rstrip("/") + PARTS_SUFFIX


def consumed_path(events_path: str) -> str:
    """Ledger of load parts the copy task has consumed."""
    return events_path.rstrip("/") + CONSUMED_SUFFIX


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger, empty before its first batch. Its ``load_day`` folders prune."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _name_filter(names: DataFrame) -> DataFrame:
    """Filters by load_day of ledger rows (source_file, load_day)."""
    days = [r[0] for r in names.select("load_day").distinct().collect()]  # dates, not rows
    parts = [key_filter(names.where(F.col("load_day").eqNullSafe(F.lit(d))), ["source_file"], FILTER_BLOCKS)
             .withColumn("load_day", F.lit(d).cast("date")) for d in days]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def ledger_for(spark: SparkSession, raw_path: str, names: DataFrame) -> DataFrame:
    """The file ledger as far as it may hold one of ``names`` (source_file): days whose filter holds none of
    them are not read. Filters are published with their ledger rows; a ledger from before them gets them once.
    Hold the writer lock."""
    ledger = read_ledger(spark, files_path(raw_path), FILES_SCHEMA)
    if not list_dirs(spark, files_path(raw_path)):
        return ledger
    if not path_exists(spark, filter_path(raw_path)):
        missing = Publication(spark, work_root(raw_path), new_batch("filter"))
        _name_filter(ledger).write.partitionBy("load_day").parquet(missing.stage("filter"))
        missing.commit({"filter": filter_path(raw_path)})
    filters = spark.read.schema(FILTER_SCHEMA).parquet(filter_path(raw_path))
    days = [r[0] for r in groups_that_may_hold(names, ["source_file"], filters, "load_day", FILTER_BLOCKS).collect()]  # dates, not rows
    return ledger.where(F.col("load_day").isin(days))


def normalize_path(col: Column) -> Column:
    """One spelling for local file URIs (``file:///x`` and ``file:/x``)."""
    return F.regexp_replace(col, r"^file:/+", "file:/")


# ---------------------------------------------------------------------------
# Landing -> raw.
# ---------------------------------------------------------------------------

FILES_PER_BATCH = 10_000


def list_landing_files(spark: SparkSession, landing_path: str, modified_after: str | None = None) -> DataFrame:
    """Landing files as a DataFrame of ``path`` (metadata only: the content
    is never read).  ``modified_after`` is UTC, whatever the session's zone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after).option("timeZone", "UTC")
    return reader.load(landing_path).select("path")


def load_files(spark: SparkSession, files: DataFrame, raw_path: str, load_time: Column | None = None,
               files_per_batch: int = FILES_PER_BATCH, wait: float = 3600.0) -> int:
    """Load the landing files (a DataFrame of ``path``) that the raw table
    has not loaded yet; return the rows appended.

    The names are written once, matched with the ledger days that may hold
    them by an anti join, and, if they are too many for one batch, dealt once
    into folders of about ``files_per_batch`` names by a hash, so that each
    batch reads its own names only; one batch's names are with the driver at
    a time, since a reader takes its paths from there.  Any number of files
    is loaded.  Each batch is published whole or
    not at all; a file is in the ledger exactly if its rows are in the table.
    """
    root = work_root(raw_path)
    with writer(spark, root, wait):
        listing = Publication(spark, root, new_batch("listing"))
        (files.select(normalize_path(F.col("path")).alias("source_file")).distinct().write.parquet(listing.stage("found")))
        found = spark.read.schema("source_file STRING").parquet(listing.stage("found"))
        ledger = ledger_for(spark, raw_path, found)
        seen = Observation("listing")
        (found.join(ledger.select("source_file"), "source_file", "left_anti")
         .observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(listing.stage("names")))
        total = 0
        for names in _dealt(spark, listing, -(-int(seen.get["n"]) // files_per_batch)):
            total += _load_batch(spark, root, [r[0] for r in names.collect()], raw_path, load_time)
        listing.discard()
        return total


def _dealt(spark: SparkSession, listing: Publication, batches: int) -> Iterator[DataFrame]:
    """The staged names in batches, each name read once to be dealt and once in its batch."""
    names = spark.read.schema("source_file STRING").parquet(listing.stage("names"))
    if batches == 1:
        yield names
    elif batches > 1:
        (names.withColumn("batch_no", F.pmod(F.xxhash64("source_file"), F.lit(batches))).repartition("batch_no")
         .write.partitionBy("batch_no").parquet(listing.stage("dealt")))
        for folder in list_dirs(spark, listing.stage("dealt")):
            if folder.startswith("batch_no="):
                yield spark.read.schema("source_file STRING").parquet(f"{listing.stage('dealt')}/{folder}")


def _load_batch(spark: SparkSession, root: str, names: list[str], raw_path: str, load_time: Column | None) -> int:
    if not names:
        return 0
    load = Publication(spark, root, new_batch("load"))
    raw = enrich(read_records(spark, names), load_time) \
        .withColumn("load_part", F.concat_ws("-", F.lit(load.batch), F.spark_partition_id()))
    _by_date(raw).parquet(load.stage("raw"))
    return _publish_load(spark, load, names, raw_path)


def _by_date(df: DataFrame):
    """One file per task and event date, so that a load part's rows of a date stay together."""
    return df.write.mode("append").option("maxRecordsPerFile", 0).partitionBy("event_date")


def _today() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


def _publish_load(spark: SparkSession, load: Publication, names: list[str], raw_path: str) -> int:
    today = F.lit(_today())
    staged = spark.read.schema(RAW_SCHEMA).parquet(load.stage("raw")).select(*PART_KEYS, "insertion_timestamp")
    rows = Observation("load")
    (staged.observe(rows, F.count(F.lit(1)).alias("n"))
     .groupBy(*PART_KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.max("insertion_timestamp").alias("insertion_timestamp"))
     .withColumn("load_day", today).coalesce(1)  # one short row per task and date
     .write.partitionBy("load_day").parquet(load.stage("parts")))
    listed = spark.createDataFrame([(n,) for n in names], "source_file STRING")
    (listed.select("source_file", F.lit(load.batch).alias("batch"), today.alias("load_day")).coalesce(1)
     .write.partitionBy("load_day").parquet(load.stage("files")))
    (key_filter(listed, ["source_file"], FILTER_BLOCKS).withColumn("load_day", today).coalesce(1)
     .write.partitionBy("load_day").parquet(load.stage("filter")))
    load.commit({"raw": raw_path, "parts": parts_path(raw_path), "files": files_path(raw_path), "filter": filter_path(raw_path)})
    return int(rows.get["n"])


BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def landing_files_stream(spark: SparkSession, landing_path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """New landing files as a stream of names (the content is not read
    here; the load reads each new file once)."""
    return (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .load(landing_path).select("path"))


def start_raw_load(spark: SparkSession, landing_path: str, raw_path: str, checkpoint: str,
                   load_time: Column | None = None, available_now: bool = True,
                   processing_time: str = "1 minute", max_files_per_trigger: int = 1000) -> StreamingQuery:
    """The pipe (S2): landing files -> raw events, incrementally."""
    register(spark)
    files = landing_files_stream(spark, landing_path, max_files_per_trigger)

    def load_batch(df: DataFrame, _batch_id: int) -> None:
        load_files(df.sparkSession, df, raw_path, load_time)

    writer_ = files.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint)
    writer_ = writer_.trigger(availableNow=True) if available_now else writer_.trigger(processingTime=processing_time)
    return writer_.start()


def load_landing_batch(spark: SparkSession, landing_path: str, raw_path: str,
                       load_time: Column | None = None, files_per_batch: int = FILES_PER_BATCH) -> int:
    """Bulk load (K4, COPY INTO) as a batch job, idempotent by file."""
    return load_files(spark, list_landing_files(spark, landing_path), raw_path, load_time, files_per_batch)


def refresh_missed_files(spark: SparkSession, landing_path: str, raw_path: str, modified_after: str,
                         load_time: Column | None = None, files_per_batch: int = FILES_PER_BATCH,
                         wait: float = 3600.0) -> int:
    """Load files changed after ``modified_after`` (UTC) that the pipe missed
    (S6, W11).  ``modifiedAfter`` is a batch-only option, so the listing is
    a batch scan of file names; the ledger keeps already-loaded files out,
    and the writer lock those that a running load is about to publish."""
    return load_files(spark, list_landing_files(spark, landing_path, modified_after), raw_path, load_time,
                      files_per_batch, wait)


# ---------------------------------------------------------------------------
# Raw -> events.
# ---------------------------------------------------------------------------


def append_events(raw_batch: DataFrame, events_path: str, with_metadata: bool = True, wait: float = 3600.0) -> int:
    """Decompose the raw rows whose load part was not consumed before, append
    the events, and return the rows appended.

    The consumed ledger has one short row per load part and event date; rows
    meet it in an equi-join on that key.  Events and the batch's ledger rows
    are published together, so a replay finds the parts consumed and a crash
    leaves them unconsumed with no event written.
    """
    spark, root = raw_batch.sparkSession, work_root(events_path)
    with writer(spark, root, wait):
        done = read_ledger(spark, consumed_path(events_path), PARTS_SCHEMA).select(*PART_KEYS)
        fresh = raw_batch
        if path_exists(spark, consumed_path(events_path)):
            fresh = raw_batch.join(done, [raw_batch[k].eqNullSafe(done[k]) for k in PART_KEYS], "left_anti")
        copy = Publication(spark, root, new_batch("copy"))
        rows = Observation("copy")
        events = decompose(fresh, with_metadata=with_metadata, lineage=["load_part"])
        _by_date(events.observe(rows, F.count(F.lit(1)).alias("n"))).parquet(copy.stage("events"))
        appended = int(rows.get["n"])
        if appended:
            _publish_copy(spark, copy, events_path)
        else:
            copy.discard()
        return appended


def _publish_copy(spark: SparkSession, copy: Publication, events_path: str) -> None:
    """Ledger rows from the staged events' own key columns, then everything at once."""
    staged = spark.read.schema(EVENTS_SCHEMA + ", load_part STRING").parquet(copy.stage("events")) \
        .select(*PART_KEYS, "insertion_timestamp")
    (staged.groupBy(*PART_KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.max("insertion_timestamp").alias("insertion_timestamp"))
     .withColumn("load_day", F.to_date("insertion_timestamp")).coalesce(1)  # one short row per part and date
     .write.partitionBy("load_day").parquet(copy.stage("consumed")))
    copy.commit({"events": events_path, "consumed": consumed_path(events_path)})


def start_decompose(spark: SparkSession, raw_path: str, events_path: str, checkpoint: str,
                    with_metadata: bool = True, available_now: bool = True,
                    processing_time: str = "1 hour", max_files_per_trigger: int = FILES_PER_BATCH) -> StreamingQuery:
    """The copy task (W3/W4) on the raw table's new files, rewritten ones included."""
    register(spark)
    raw = only_inserts(spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
                       .parquet(raw_path))
    writer_ = (raw.writeStream.foreachBatch(lambda df, _id: append_events(df, events_path, with_metadata) and None)
               .option("checkpointLocation", checkpoint))
    writer_ = writer_.trigger(availableNow=True) if available_now else writer_.trigger(processingTime=processing_time)
    return writer_.start()


def run_once(query: StreamingQuery) -> int:
    """Wait for an ``availableNow`` query; return the input rows it read."""
    query.awaitTermination()
    return int(sum(p.get("numInputRows", 0) for p in query.recentProgress))


# ---------------------------------------------------------------------------
# Ledgers.
# ---------------------------------------------------------------------------


def merged_filters(filters: DataFrame) -> DataFrame:
    """One bitmap of each block and day."""
    return filters.groupBy("load_day", "filter_block").agg(F.bitmap_or_agg("filter_bits").alias("filter_bits"))


def compact_ledger(spark: SparkSession, table_path: str, ledger: str, schema: str, wait: float = 3600.0,
                   merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
    """Rewrite every ledger day of more than one file into one, its rows passed
    through ``merge``; return the days rewritten.  ``table_path`` is the table
    whose writers own the ledger."""
    root, days = work_root(table_path), 0
    with writer(spark, root, wait):
        for day in list_dirs(spark, ledger):
            files = [f"{ledger}/{day}/{f}" for f in list_files(spark, f"{ledger}/{day}", ".parquet")]
            if len(files) < 2:
                continue
            merged = Publication(spark, root, new_batch("compact"))
            (merge(spark.read.schema(schema).option("basePath", ledger).parquet(f"{ledger}/{day}"))
             .coalesce(1)  # a day's ledger: one short row per file or part
             .write.partitionBy("load_day").parquet(merged.stage("ledger")))
            merged.commit({"ledger": ledger}, remove=files)
            days += 1
    return days


def stream_lag(spark: SparkSession, raw_path: str, events_path: str, as_of: Column | None = None) -> DataFrame:
    """Transform lag of the copy task from its ledgers.

    Pending: load parts that were not consumed and still have rows in the
    raw table (two narrow columns of the pending dates are read to leave out
    trimmed ones).  The offset time is the latest load time consumed; with
    nothing consumed yet, the earliest load time pending.  Returns one row:
    pending_parts, offset_time, lag_minutes (DOUBLE, 0 with nothing pending).
    """
    import tidelake.functions as W

    as_of = W.utc_now() if as_of is None else as_of
    loaded = read_ledger(spark, parts_path(raw_path), PARTS_SCHEMA)
    consumed = read_ledger(spark, consumed_path(events_path), PARTS_SCHEMA)
    pending = loaded.join(consumed, [loaded[k].eqNullSafe(consumed[k]) for k in PART_KEYS], "left_anti")
    days = [r[0] for r in pending.select("event_date").distinct().collect()]  # dates, not rows
    raw = spark.read.schema(RAW_SCHEMA).parquet(raw_path)
    present = raw.where(F.col("event_date").isin([d for d in days if d is not None]) |
                        (F.lit(None in days) & F.col("event_date").isNull())).select(*PART_KEYS).distinct()
    pending = pending.join(present, [pending[k].eqNullSafe(present[k]) for k in PART_KEYS], "left_semi")
    last = consumed.agg(F.max("insertion_timestamp")).first()[0]
    waits = pending.agg(F.count(F.lit(1)).alias("pending_parts"), F.min("insertion_timestamp").alias("first_pending"))
    offset = F.coalesce(F.lit(last).cast("timestamp_ntz"), F.col("first_pending"))
    return waits.select(
        "pending_parts", offset.alias("offset_time"),
        F.when(F.col("pending_parts") > 0, W.datediff_minutes(offset, as_of).cast("double"))
        .otherwise(F.lit(0.0)).alias("lag_minutes"))
