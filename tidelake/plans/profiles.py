"""Registered queries of the nested profile (J2, J7), indented JSON (J6) and the hash sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidelake.functions as W
from tidelake.operators import profile
from tidelake.sources.landing import landing_records
from tidelake.sources.tables import read_dealt, read_table

SAMPLE = 64


def json_path_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of every path of the raw records, members of objects and elements of arrays."""
    records = landing_records(read_dealt(spark, sf_dir, "events")).select(F.parse_json("record").alias("record"))
    return profile.path_types(records, "record")


def indented_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as indented JSON text, and whether that text reads back to the same value."""
    doc = F.to_json(F.struct(F.col("event_type").alias("a"), F.parse_json("props").alias("b"),
                             F.array(F.struct(F.col("user_id").cast("string").alias("id")), F.struct(F.lit('{"[,:]}').alias("id"))).alias("c"),
                             F.array().cast("array<string>").alias("d")))
    values = read_dealt(spark, sf_dir, "events").select("event_id", F.parse_json(doc).alias("v")).select(
        "event_id", "v", W.indented_json("v").alias("text"))
    return values.select("event_id", "text", (F.to_json(F.parse_json("text")) == F.to_json("v")).alias("reads_back"))


def document_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language the documents of the smallest hashes, and how many different texts there are."""
    return profile.hash_sample(read_table(spark, sf_dir, "documents"), "lang", "text", "doc_id", SAMPLE)


QUERIES = {f.__name__: f for f in (json_path_profile, indented_json_events, document_hash_sample)}

ORACLES = {
    "json_path_profile": """
WITH records AS (
  SELECT json_object(
    'uuid', CAST(event_id AS VARCHAR), 'timestamp', CAST(ts AS VARCHAR), 'event_type', event_type, 'version', '0',
    'org_id', 'org-' || CAST(user_id AS VARCHAR), 'display_message_entry', json_array(event_type || ' event'),
    'severity', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, 'client', json_object('id', user_id),
    'actor', CASE WHEN event_type = 'signup' THEN json('"anonymous"') ELSE json_object('id', user_id, 'type', 'User') END,
    'outcome', json_object('result', CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END,
                           'value_cents', CAST(round(value * 100) AS BIGINT)),
    'target', json_array(json_object('id', event_id, 'type', event_type)),
    'transaction', json_object('id', 'tx-' || CAST(event_id AS VARCHAR)),
    'debug_context', json_object('debugData', json(props)),
    'metadata', CASE WHEN ts < TIMESTAMP '2024-01-08' THEN json('[' || props || ']') ELSE json(props) END) AS r
  FROM events)
SELECT regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path,
       CASE t.type WHEN 'NULL' THEN 'NULL_VALUE' WHEN 'UBIGINT' THEN 'INTEGER' WHEN 'BIGINT' THEN 'INTEGER'
                   WHEN 'DOUBLE' THEN 'DECIMAL' ELSE t.type END AS type_name,
       count(*) AS n
FROM records, json_tree(records.r) AS t GROUP BY ALL
""",
    "indented_json_events": """
WITH d AS (
  SELECT event_id, json_pretty(json_object('a', event_type, 'b', json(props),
                                           'c', json_array(json_object('id', CAST(user_id AS VARCHAR)), json_object('id', '{"[,:]}')),
                                           'd', json('[]'))) AS t
  FROM events)
SELECT event_id, replace(replace(replace(replace(replace(t, chr(10) || repeat(' ', 12), chr(10) || '######'), chr(10) || repeat(' ', 8), chr(10) || '@@@@'),
                 chr(10) || repeat(' ', 4), chr(10) || '  '), '@@@@', repeat(' ', 4)), '######', repeat(' ', 6)) AS text, TRUE AS reads_back
FROM d
""",
    "document_hash_sample": """
WITH h AS (
  SELECT lang, CAST(CAST(concat('0x', right(md5(text), 16)) AS UBIGINT) AS DECIMAL(20,0)) AS text_hash,
         min(doc_id) AS first_key, count(*) AS n_copies
  FROM documents WHERE text IS NOT NULL GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY text_hash) AS place FROM h QUALIFY place <= 64)
SELECT lang, place, text_hash, first_key, n_copies,
       CAST(CASE WHEN count(*) OVER (PARTITION BY lang) < 64 THEN count(*) OVER (PARTITION BY lang)
                 ELSE floor(CAST(63 * 18446744073709551616.0 AS DOUBLE) / CAST(max(text_hash) OVER (PARTITION BY lang) AS DOUBLE)) END AS BIGINT) AS distinct_estimate
FROM s
""",
}
