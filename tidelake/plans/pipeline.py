"""The event lake as one object: its tasks and procedures as methods.

``EventLake`` ties the pieces to one set of folders: landing zone, raw and
events tables, the load ledger, stream checkpoints and the cleanup
history.  The clock (``now``/``as_of``) is a parameter, so any scheduler
can drive it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelake.operators import maintenance, retention
from tidelake.operators.events import EVENTS_SCHEMA
from tidelake.sources.landing import RAW_SCHEMA
from tidelake.session import shared_dir
from tidelake.streaming import ingest
from tidelake.util import path_exists


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass
class EventLake:
    spark: SparkSession
    landing: str
    root: str | None = None

    def __post_init__(self) -> None:
        self.root = (self.root or f"{shared_dir(self.spark)}/tidelake/lake").rstrip("/")

    # ---- locations ------------------------------------------------------
    @property
    def raw_path(self) -> str:
        return f"{self.root}/raw_events"

    @property
    def events_path(self) -> str:
        return f"{self.root}/events"

    @property
    def history_path(self) -> str:
        return f"{self.root}/sensitive_cleanup_history"

    def _checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"

    # ---- tables ---------------------------------------------------------
    def raw(self) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMA).parquet(self.raw_path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS_SCHEMA).parquet(self.events_path)

    def history(self) -> DataFrame:
        return self.spark.read.schema(retention.HISTORY_SCHEMA).parquet(self.history_path)

    # ---- tasks ----------------------------------------------------------
    def load(self, available_now: bool = True, load_time: Column | None = None) -> StreamingQuery:
        """The pipe (S2): new landing files -> raw events."""
        return ingest.start_raw_load(self.spark, self.landing, self.raw_path, self._checkpoint("raw"),
                                     load_time=load_time, available_now=available_now)

    def copy_to_events(self, available_now: bool = True, with_metadata: bool = True) -> StreamingQuery:
        """The copy task (W3/W4): new raw rows -> typed events."""
        return ingest.start_decompose(self.spark, self.raw_path, self.events_path, self._checkpoint("events"),
                                      with_metadata=with_metadata, available_now=available_now)

    def run_once(self) -> None:
        """One scheduled round: load what landed, then decompose it."""
        ingest.run_once(self.load())
        if path_exists(self.spark, self.raw_path):
            ingest.run_once(self.copy_to_events())

    def refresh(self, now: dt.datetime | None = None) -> int:
        """Missed-file refresh (W11): files modified in the last day and
        five minutes that the pipe has not loaded."""
        since = (now or _utc_now()) - dt.timedelta(days=1, minutes=5)
        return ingest.refresh_missed_files(self.spark, self.landing, self.raw_path,
                                           since.strftime("%Y-%m-%dT%H:%M:%S"))

    def trim(self, as_of: dt.datetime | None = None) -> dict[str, int]:
        """Retention over both tables (W9): keep one year."""
        return retention.trim_old_sensitive_data(self.spark, self.raw_path, self.events_path,
                                                 self.history_path, as_of or _utc_now())

    def lag_minutes(self, as_of: dt.datetime | None = None, by: list[str] | None = None) -> DataFrame:
        """Transform lag from the rows (W6), optionally per group."""
        at = F.lit(as_of).cast("timestamp_ntz") if as_of else None
        events = self.events() if path_exists(self.spark, self.events_path) else \
            self.raw().limit(0).select(F.lit(None).cast("string").alias("uuid"))
        return maintenance.transform_lag(self.raw(), events, as_of=at, by=by)

    def stream_lag_minutes(self, as_of: dt.datetime | None = None) -> DataFrame:
        """W6/W12 from the load and consumed ledgers: one row per load part."""
        at = F.lit(as_of).cast("timestamp_ntz") if as_of else None
        return ingest.stream_lag(self.spark, self.raw_path, self.events_path, as_of=at)

    def backfill_metadata(self) -> int:
        """Fill the stored events' metadata; returns the partitions rewritten."""
        return maintenance.write_backfill(self.spark, self.events_path, self.raw())

    def compact_ledgers(self) -> int:
        """Merge each ledger day's small files; returns the days rewritten."""
        filters = ingest.compact_ledger(self.spark, self.raw_path, ingest.filter_path(self.raw_path), ingest.FILTER_SCHEMA,
                                        merge=ingest.merged_filters)
        return filters + sum(ingest.compact_ledger(self.spark, table, ledger, schema) for table, ledger, schema in (
            (self.raw_path, ingest.files_path(self.raw_path), ingest.FILES_SCHEMA),
            (self.raw_path, ingest.parts_path(self.raw_path), ingest.PARTS_SCHEMA),
            (self.events_path, ingest.consumed_path(self.events_path), ingest.PARTS_SCHEMA)))

    def create_views(self, schema: str) -> tuple[str, str]:
        """Reduced-column views over catalog tables for raw and events."""
        from tidelake.operators.catalog import create_schema
        create_schema(self.spark, schema, location=f"{self.root}/_warehouse/{schema}.db")
        names = {}
        for label, path, ddl in (("raw_events", self.raw_path, RAW_SCHEMA),
                                 ("events", self.events_path, EVENTS_SCHEMA)):
            name = f"{schema}.{label}"
            # Declared columns: the folder may be empty (fresh or fully trimmed).
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet "
                           f"PARTITIONED BY (event_date) LOCATION '{path}'")
            self.spark.sql(f"REPAIR TABLE {name}")
            names[label] = name
        return maintenance.create_reduced_views(self.spark, names["events"], names["raw_events"], schema)
