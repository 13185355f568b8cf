"""Retention trims and their cleanup history.

Parquet tables have no DELETE, so a trim works on the folders of a table
partitioned by ``event_date``:

* partitions wholly below the threshold's date go as folders; their rows
  are counted from the file footers (no column is read);
* the one partition that straddles the threshold is read once: its kept
  rows are staged while they and all rows are counted;
* the history row is staged as well, and everything happens in one
  publication (:mod:`tidelake.streaming.publish`): before its marker the
  trim has not happened, after it the next writer finishes whatever is
  left, and the history counts the rows that really went.

Staged files lie outside the table, so the table is readable at any time.
Between the moves and the removals a reader may see a kept row twice, but
never miss one.  Rewritten rows keep their ``load_part``, by which the copy
task knows whether it has consumed them.

Rows whose time is NULL are never deleted (``NULL < t`` is unknown, Q3):
they sit in the NULL partition, which no date comparison selects.
"""

from __future__ import annotations

import datetime as dt
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import tidelake.functions as W
from tidelake.sources.landing import event_time
from tidelake.streaming.publish import Publication, new_batch, work_root, writer
from tidelake.util import list_dirs, list_files, path_exists, read_parquet_table

HISTORY_SCHEMA = "execution_time TIMESTAMP_NTZ, table_name STRING, deleted_records DECIMAL(38,0)"
HISTORY_COMMENT = "One row for each retention trim: when it ran, on which table, how many rows it deleted"
HISTORY_RETENTION_DAYS = 90


def parse_threshold(spark: SparkSession, time_value: str) -> dt.datetime:
    """``TO_TIMESTAMP(:1)`` on the bound text: ISO or epoch digits.
    Evaluated by Spark so the parameter means what it means in SQL."""
    value = spark.range(1).select(W.to_timestamp(F.lit(time_value))).first()[0]
    if value is None:
        raise ValueError(f"not a time: {time_value!r}")
    return value


def one_year_before(as_of: dt.datetime) -> str:
    """W9's threshold: as_of minus one calendar year, as epoch milliseconds
    text (the form the scheduled procedure passes, Q2)."""
    try:
        earlier = as_of.replace(year=as_of.year - 1)
    except ValueError:  # 29 February
        earlier = as_of.replace(year=as_of.year - 1, day=28)
    epoch = dt.datetime(1970, 1, 1)
    return str(int((earlier - epoch).total_seconds() * 1000))


def trim_partitioned(spark: SparkSession, path: str, time_of: Column, threshold: dt.datetime,
                     partition_col: str = "event_date", wait: float = 3600.0) -> int:
    """Delete rows with ``time_of < threshold``, unrecorded; return how many went."""
    return _trim_and_record(spark, path, time_of, threshold, partition_col, None, wait)


def _trim_and_record(spark: SparkSession, path: str, time_of: Column, threshold: dt.datetime, partition_col: str,
                     record: tuple[str, str, dt.datetime | None] | None, wait: float = 3600.0) -> int:
    """``trim_partitioned``; ``record``: (history folder, table name, execution time)."""
    cut_date, prefix = threshold.date(), f"{partition_col}="
    root = work_root(path)
    with writer(spark, root, wait):
        trim = Publication(spark, root, new_batch("trim"))
        targets, remove, deleted = {}, [], 0
        table = read_parquet_table(spark, path) if path_exists(spark, path) else None
        if table is not None:
            below = [n for n in list_dirs(spark, path) if n.startswith(prefix)
                     and not n.endswith("__HIVE_DEFAULT_PARTITION__") and n[len(prefix):] < cut_date.isoformat()]
            if below:
                deleted += table.where(F.col(partition_col) < F.lit(cut_date)).count()
                remove += [f"{path}/{n}" for n in below]
            boundary = f"{path}/{prefix}{cut_date.isoformat()}"
            files = list_files(spark, boundary, ".parquet")
            if files:
                gone = _stage_boundary(table, partition_col, cut_date, time_of, threshold, trim)
                deleted += gone
                if gone:
                    targets["kept"] = boundary
                    remove += [f"{boundary}/{f}" for f in files]
        if record is not None:
            history_path, name, execution_time = record
            _history_row(spark, name, deleted, execution_time).write.parquet(trim.stage("history"))
            targets["history"] = history_path
        if targets or remove:
            trim.commit(targets, remove)
        else:
            trim.discard()
        return deleted


def delete_where(spark: SparkSession, path: str, predicate: Column | str, partition_col: str = "event_date",
                 record: tuple[str, str, dt.datetime | None] | None = None, wait: float = 3600.0) -> int:
    """``DELETE FROM .. WHERE predicate`` (K5) on a partitioned parquet table; return how many rows went.

    Copy-on-write by file: one scan, with the predicate pushed down, counts the
    rows that match in each file; only files with a match are read again and
    written without them, all others stay as they are. A row for which the
    predicate is NULL is kept. New files, removals and the history row
    (``record``: history folder, table name, execution time) are one
    publication.
    """
    doomed = F.expr(predicate) if isinstance(predicate, str) else predicate
    root = work_root(path)
    with writer(spark, root, wait):
        delete = Publication(spark, root, new_batch("delete"))
        targets, remove, deleted = {}, [], 0
        table = read_parquet_table(spark, path) if path_exists(spark, path) else None
        if table is not None:
            hit = (table.where(doomed).groupBy(F.col("_metadata.file_path").alias("file"))
                   .agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each file that is rewritten
            deleted, remove = sum(r["n"] for r in hit), [unquote(r["file"]) for r in hit]
        if remove:
            (spark.read.schema(table.schema).option("basePath", path).parquet(*remove)
             .where(~F.coalesce(doomed, F.lit(False))).write.partitionBy(partition_col).parquet(delete.stage("kept")))
            targets["kept"] = path
        if record is not None:
            history_path, name, execution_time = record
            _history_row(spark, name, deleted, execution_time).write.parquet(delete.stage("history"))
            targets["history"] = history_path
        if targets:
            delete.commit(targets, remove)
        else:
            delete.discard()
        return deleted


def _stage_boundary(table: DataFrame, partition_col: str, day: dt.date, time_of: Column, threshold: dt.datetime,
                    trim: Publication) -> int:
    """Stage the kept rows of the straddling partition; return how many rows go."""
    doomed = F.coalesce(time_of < F.lit(threshold).cast("timestamp_ntz"), F.lit(False))
    read, kept = Observation("read"), Observation("kept")
    (table.where(F.col(partition_col) == F.lit(day)).observe(read, F.count(F.lit(1)).alias("n"))
     .where(~doomed).observe(kept, F.count(F.lit(1)).alias("n"))
     .drop(partition_col).write.parquet(trim.stage("kept")))
    return int(read.get["n"]) - int(kept.get["n"])


def _history_row(spark: SparkSession, table_name: str, deleted: int, execution_time: dt.datetime | None) -> DataFrame:
    row = [(execution_time or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), table_name, deleted)]
    return (spark.createDataFrame(row, "execution_time timestamp_ntz, table_name string, deleted_records long")
            .select("execution_time", "table_name", F.col("deleted_records").cast("decimal(38,0)")))


def create_history_table(spark: SparkSession, name: str, location: str) -> None:
    """The cleanup history as a catalog table with comment and retention
    property (K6, K14); the property is metadata only."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({HISTORY_SCHEMA}) USING parquet "
              f"LOCATION '{location}' COMMENT '{HISTORY_COMMENT}' "
              f"TBLPROPERTIES ('data_retention_time_in_days' = '{HISTORY_RETENTION_DAYS}')")


def trim_sensitive_raw_events(spark: SparkSession, raw_path: str, time_value: str, history_path: str,
                              execution_time: dt.datetime | None = None) -> int:
    """Delete raw events whose JSON time is before ``time_value``."""
    return _trim_and_record(spark, raw_path, event_time(F.col("raw_json")), parse_threshold(spark, time_value),
                            "event_date", (history_path, "sensitive.raw_events", execution_time))


def trim_sensitive_events(spark: SparkSession, events_path: str, time_value: str, history_path: str,
                          execution_time: dt.datetime | None = None) -> int:
    """Delete typed events whose ``timestamp`` is before ``time_value``."""
    return _trim_and_record(spark, events_path, F.col("timestamp"), parse_threshold(spark, time_value),
                            "event_date", (history_path, "sensitive.events", execution_time))


def trim_old_sensitive_data(spark: SparkSession, raw_path: str, events_path: str, history_path: str,
                            as_of: dt.datetime) -> dict[str, int]:
    """Trim both tables to one year before ``as_of`` (the clock is a
    parameter; a scheduler passes now)."""
    threshold = one_year_before(as_of)
    return {
        "sensitive.raw_events": trim_sensitive_raw_events(spark, raw_path, threshold, history_path, as_of),
        "sensitive.events": trim_sensitive_events(spark, events_path, threshold, history_path, as_of),
    }


def kept_rows(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Rows left per table, one aggregate per table, unioned."""
    parts = []
    for name, p in tables.items():
        df = read_parquet_table(spark, p)
        counted = (df.agg(F.count(F.lit(1)).alias("kept_records")) if df is not None
                   else spark.range(1).select(F.lit(0).cast("bigint").alias("kept_records")))
        parts.append(counted.select(F.lit(name).alias("table_name"), "kept_records"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
