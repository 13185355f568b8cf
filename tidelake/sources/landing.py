"""Landing zone: JSON files under ``cell=<id>/`` folders.

* :func:`landing_records` shapes the ``events`` test table as the records a
  producer would drop in the landing zone (one JSON object per line).
* :func:`scan_landing` is the stage scan: every record becomes one VARIANT
  column plus the file it came from.
* :func:`enrich` is the load projection of the pipe: load time, ``org_id``
  and ``cell`` (known only from the file path), the raw record, the source
  file and an ``event_date`` used to partition the raw table.
* loading, the missed-file refresh and the load ledger live in
  :mod:`tidelake.streaming.ingest`.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidelake.functions as W

CELL_PATTERN = "cell=([[:alnum:]]+)/"


def epoch_ntz() -> Column:
    return F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz")

# Records emitted before this day carry ``metadata`` as an array of
# {key: value} objects (the legacy shape); later ones as an object.
LEGACY_METADATA_BEFORE = "2024-01-08"

# ``rescued_text`` keeps a line that is no JSON; ``load_part`` names the task that loaded a row.
RAW_SCHEMA = ("insertion_timestamp TIMESTAMP_NTZ, org_id STRING, cell STRING, raw_json VARIANT, "
              "source_file STRING, rescued_text STRING, load_part STRING, event_date DATE")


def landing_records(events: DataFrame) -> DataFrame:
    """Shape test ``events`` rows as landing-zone records.

    Returns ``cell``, ``record`` (JSON text) and ``event_ts`` (the event time,
    kept only so callers can simulate load times).  Producers differ:
    purchase events stamp epoch-millisecond text, the others ISO text;
    signup actors are an anonymous string rather than an object.
    """
    ts_text = F.when(
        F.col("event_type") == "purchase",
        F.timestamp_diff("MILLISECOND", epoch_ntz(), F.col("ts")).cast("string"),
    ).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    props = F.parse_json(F.col("props"))
    actor = F.when(F.col("event_type") == "signup", F.parse_json(F.lit('"anonymous"'))).otherwise(
        F.to_variant_object(F.struct(F.col("user_id").alias("id"), F.lit("User").alias("type"))))
    metadata = F.when(F.col("ts") < F.lit(LEGACY_METADATA_BEFORE).cast("timestamp_ntz"),
                      F.parse_json(F.concat(F.lit("["), F.col("props"), F.lit("]")))).otherwise(props)
    record = F.struct(
        F.col("event_id").cast("string").alias("uuid"),
        ts_text.alias("timestamp"),
        F.col("event_type").alias("event_type"),
        F.lit("0").alias("version"),
        F.concat(F.lit("org-"), F.col("user_id").cast("string")).alias("org_id"),
        F.array(F.concat(F.col("event_type"), F.lit(" event"))).alias("display_message_entry"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("severity"),
        F.struct(F.col("user_id").alias("id")).alias("client"),
        actor.alias("actor"),
        F.struct(
            F.when(F.col("event_type") == "error", F.lit("FAILURE")).otherwise(F.lit("SUCCESS")).alias("result"),
            F.round(F.col("value") * 100).cast("bigint").alias("value_cents"),
        ).alias("outcome"),
        F.array(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("target"),
        F.struct(F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("id")).alias("transaction"),
        F.struct(props.alias("debugData")).alias("debug_context"),
        metadata.alias("metadata"),
    )
    cell = F.concat(F.lit("c"), F.lpad(F.pmod(F.col("user_id"), F.lit(8)).cast("string"), 2, "0"))
    return events.select(cell.alias("cell"), F.to_json(record).alias("record"), F.col("ts").alias("event_ts"))


def write_landing(records: DataFrame, path: str, mode: str = "append") -> None:
    """Drop records as JSON-lines files under ``path/cell=<id>/``."""
    records.select("cell", "record").write.mode(mode).partitionBy("cell").text(path)


def _records(lines: DataFrame) -> DataFrame:
    """Text lines as records: one VARIANT each, the file, and the text of a
    line that does not parse (blank lines are no records)."""
    parsed = F.try_parse_json("value")
    return lines.where(F.trim("value") != "").select(
        parsed.alias("raw_json"), F.col("_metadata.file_path").alias("source_file"),
        F.when(parsed.isNull(), F.col("value")).alias("rescued_text"))


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of the given landing files."""
    return _records(spark.read.text(paths))


def scan_landing(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """Stage scan (S1): one VARIANT per record plus its file (S3, S4);
    ``modified_after`` is UTC."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after).option("timeZone", "UTC")
    return _records(reader.text(path))


def event_time(raw_json: Column) -> Column:
    """``TO_TIMESTAMP(raw_json:timestamp::string)``: ISO or epoch text."""
    return W.to_timestamp(W.json_path(raw_json, "$.timestamp", "string"))


def enrich(scanned: DataFrame, load_time: Column | None = None) -> DataFrame:
    """Load projection of the pipe (S5, K4): the raw table's columns."""
    load_time = W.utc_now() if load_time is None else load_time
    return scanned.select(
        load_time.cast("timestamp_ntz").alias("insertion_timestamp"),
        W.json_path("raw_json", "$.org_id", "string").alias("org_id"),
        W.regexp_substr("source_file", F.lit(CELL_PATTERN), F.lit(1), F.lit(1), F.lit(1)).alias("cell"),
        F.col("raw_json"),
        F.col("source_file"),
        (F.col("rescued_text") if "rescued_text" in scanned.columns else F.lit(None).cast("string")).alias("rescued_text"),
        (F.col("load_part") if "load_part" in scanned.columns else F.col("source_file")).alias("load_part"),
        F.to_date(event_time(F.col("raw_json"))).alias("event_date"),
    )


def raw_from_records(records: DataFrame, load_time: Column) -> DataFrame:
    """Batch twin of scan + enrich for records that never became files."""
    return enrich(
        records.select(F.parse_json("record").alias("raw_json"),
                       F.concat(F.lit("landing/cell="), F.col("cell"), F.lit("/batch")).alias("source_file"),
                       *[c for c in records.columns if c not in ("record", "cell")]),
        load_time,
    )


def hourly_load_time(event_ts: Column) -> Column:
    """The top of the hour after the event: an hourly loader's clock."""
    return F.timestamp_add("HOUR", F.timestamp_diff("HOUR", epoch_ntz(), event_ts) + 1, epoch_ntz())
