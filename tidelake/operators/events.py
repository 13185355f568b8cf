"""Raw events -> typed events (W3, W4) and the output projection.

``decompose`` is the body of the copy task: it is a pure projection (no
shuffle), used unchanged by the batch job and by the streaming job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tidelake.functions as W

# The event record's field names, which are the table's columns.
STRING_FIELDS = ["uuid", "event_type", "version", "org_id", "severity"]
ARRAY_FIELDS = ["display_message_entry", "target"]
OBJECT_FIELDS = ["client", "actor", "outcome", "transaction", "debug_context",
                 "authentication_context", "security_context"]

EVENT_COLUMNS = [
    "insertion_timestamp", "cell", "uuid", "timestamp", "event_type", "version", "org_id",
    "display_message_entry", "severity", "client", "actor", "outcome", "target", "transaction",
    "debug_context", "authentication_context", "security_context",
]
EVENT_COLUMNS_WITH_METADATA = EVENT_COLUMNS + ["metadata"]
VARIANT_COLUMNS = ARRAY_FIELDS + OBJECT_FIELDS + ["metadata"]

# The events table as stored (partitioned by event_date).  Reading with it
# keeps an emptied table readable and a table written before ``metadata``
# existed readable with NULLs.
EVENTS_SCHEMA = (
    "insertion_timestamp TIMESTAMP_NTZ, cell STRING, uuid STRING, timestamp TIMESTAMP_NTZ, "
    "event_type STRING, version STRING, org_id STRING, display_message_entry ARRAY<VARIANT>, "
    "severity STRING, client VARIANT, actor VARIANT, outcome VARIANT, target ARRAY<VARIANT>, "
    "transaction VARIANT, debug_context VARIANT, authentication_context VARIANT, "
    "security_context VARIANT, metadata VARIANT, event_date DATE")


def decompose(raw: DataFrame, with_metadata: bool = True, keep_event_date: bool = True,
              lineage: list[str] | None = None) -> DataFrame:
    """Typed events from raw events.

    ``::string`` fields become STRING, ``::array`` fields ARRAY<VARIANT>,
    ``::object`` fields VARIANT holding an object (NULL for anything else, so
    old array-shaped ``metadata`` never lands as an object: Q4).  Columns
    named in ``lineage`` are carried along.
    """
    names = EVENT_COLUMNS_WITH_METADATA if with_metadata else EVENT_COLUMNS
    objects = [*OBJECT_FIELDS, *["metadata"] * with_metadata]
    # One walk over the record takes its fields apart; the casts then read only their own field.
    record = f"_record_{uuid.uuid4().hex[:8]}"
    fields = ", ".join(f"`{n}`: variant" for n in ["timestamp", *STRING_FIELDS, *ARRAY_FIELDS, *objects])
    raw = raw.withColumn(record, W.json_path("raw_json", "$", f"struct<{fields}>"))
    cols = {
        "insertion_timestamp": F.col("insertion_timestamp"),
        "cell": F.col("cell"),
        "timestamp": W.to_timestamp(W.json_path(f"{record}.timestamp", "$", "string")),
    }
    for name in STRING_FIELDS:
        cols[name] = W.json_path(f"{record}.{name}", "$", "string")
    for name in ARRAY_FIELDS:
        cols[name] = W.as_array(f"{record}.{name}")
    for name in objects:
        cols[name] = W.as_object(f"{record}.{name}")
    out = [cols[n].alias(n) for n in names]
    if keep_event_date:
        out.append(F.to_date(cols["timestamp"]).alias("event_date"))
    return raw.select(*out, *(lineage or []))


def only_inserts(changes: DataFrame) -> DataFrame:
    """``WHERE METADATA$ACTION = 'INSERT'``.

    On a change feed (a ``_change_type`` column) keep inserted rows; an
    append-only source (file stream, raw table) has only inserts, so the
    filter is the identity there.
    """
    if "_change_type" in changes.columns:
        return changes.where(F.col("_change_type") == "insert").drop("_change_type")
    return changes


def as_json_text(events: DataFrame) -> DataFrame:
    """Nested VARIANT columns as canonical JSON text (J5), for output and
    comparison: VARIANT cannot be sorted, hashed or compared."""
    return events.select(*[
        F.to_json(F.col(c)).alias(c) if c in VARIANT_COLUMNS else F.col(c)
        for c in events.columns
    ])
