"""DuckDB SQL equal to each job, over the same parquet tables."""

from tidelake.plans import matching, profiles

# The landing-record shape of tidelake.sources.landing, decomposed again.
EVENTS_DECOMPOSED = """
SELECT
  date_trunc('hour', ts) + INTERVAL 1 HOUR AS insertion_timestamp,
  'c' || lpad(CAST(user_id % 8 AS VARCHAR), 2, '0') AS cell,
  CAST(event_id AS VARCHAR) AS uuid,
  CASE WHEN event_type = 'purchase' THEN date_trunc('millisecond', ts) ELSE ts END AS "timestamp",
  event_type,
  '0' AS version,
  'org-' || CAST(user_id AS VARCHAR) AS org_id,
  CAST(json_array(event_type || ' event') AS VARCHAR) AS display_message_entry,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
  CAST(json_object('id', user_id) AS VARCHAR) AS client,
  CASE WHEN event_type = 'signup' THEN NULL
       ELSE CAST(json_object('id', user_id, 'type', 'User') AS VARCHAR) END AS actor,
  CAST(json_object('result', CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END,
                   'value_cents', CAST(round(value * 100) AS BIGINT)) AS VARCHAR) AS outcome,
  CAST(json_array(json_object('id', event_id, 'type', event_type)) AS VARCHAR) AS target,
  CAST(json_object('id', 'tx-' || CAST(event_id AS VARCHAR)) AS VARCHAR) AS "transaction",
  CAST(json_object('debugData', json(props)) AS VARCHAR) AS debug_context,
  CAST(NULL AS VARCHAR) AS authentication_context,
  CAST(NULL AS VARCHAR) AS security_context,
  CASE WHEN ts < TIMESTAMP '2024-01-08' THEN NULL ELSE CAST(json(props) AS VARCHAR) END AS metadata
FROM events
"""

ORACLES = {
    "events_decompose": EVENTS_DECOMPOSED,
}

CONTENT_FINGERPRINT = """
SELECT doc_id, md5(text) AS md5, hex(unhex(md5(text))) AS md5_binary_hex,
  CAST(CAST(concat('0x', right(md5(text), 16)) AS UBIGINT) AS DECIMAL(20,0)) AS md5_lower64,
  CAST(CAST(concat('0x', left(md5(text), 16)) AS UBIGINT) AS DECIMAL(20,0)) AS md5_upper64,
  CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes
FROM documents
"""

DUPLICATE_GROUPS = """
SELECT md5(text) AS md5, count(*) AS n_docs, min(doc_id) AS first_doc_id,
       CAST(sum(n_chars) AS BIGINT) AS total_chars
FROM documents GROUP BY md5(text) HAVING count(*) > 1
"""

BINARY_CODECS = """
SELECT doc_id,
  md5(hex(text)) AS hex_md5, CAST(length(hex(text)) AS BIGINT) AS hex_len,
  md5(to_base64(encode(text))) AS b64_md5, CAST(length(to_base64(encode(text))) AS BIGINT) AS b64_len,
  decode(unhex(hex(text))) = text AS hex_roundtrip_ok,
  decode(from_base64(to_base64(encode(text)))) = text AS b64_roundtrip_ok,
  hex(unhex(hex(text))) = hex(text) AS hex_binary_ok,
  CAST(octet_length(encode(text)) * 8 AS BIGINT) AS n_bits
FROM documents
"""

TEXT_SHAPE = """
SELECT doc_id, lang,
  CAST(CASE WHEN text = '' THEN 0 ELSE ord(text) END AS BIGINT) AS first_code,
  CAST(length(text) AS BIGINT) AS n_chars,
  CAST(length(rtrim(text, ' ')) AS BIGINT) AS rtrimmed_len,
  CAST(octet_length(encode(text)) AS BIGINT) AS n_octets,
  left(text, 12) AS prefix, right(text, 12) AS suffix,
  CAST(instr(text, 'the') AS BIGINT) AS pos_the,
  CAST(CASE WHEN instr(substr(text, 100), 'the') = 0 THEN 0
            ELSE instr(substr(text, 100), 'the') + 99 END AS BIGINT) AS pos_the_from_100,
  CAST(instr(text, 'é') AS BIGINT) AS pos_e_acute,
  contains(text, 'password') AS has_password,
  ends_with(text, '.') AS ends_with_period
FROM documents
"""

TEXT_EDIT = """
SELECT p_partkey,
  left(p_name, instr(p_name, ' ')) || p_type || ' ' || substr(p_name, instr(p_name, ' ') + 1) AS typed_name,
  upper(p_brand) || substr(p_name, instr(p_name, ' ')) AS branded_name,
  p_name || repeat(' ', greatest(14 - length(p_name), 0)) AS padded_name,
  repeat(left(p_type, 2), p_size % 4 + 1) AS type_stamp,
  chr(p_size * 150 + 32) AS size_glyph,
  array_to_string(list_transform(string_split(lower(p_name), ' '),
                  lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title_name
FROM part
"""

URL_PATTERN_MINING = """
SELECT page_id,
  array_to_string(regexp_extract_all(html, 'href="/[[:alnum:]]+"'), ' ') AS links,
  array_to_string(regexp_extract_all(html, 'href="/[[:alnum:]]+"')[3:], ' ') AS links_from_3rd,
  array_to_string(regexp_extract_all(substr(html, 500), 'href="/[[:alnum:]]+"'), ' ') AS links_after_500,
  regexp_extract_all(html, 'href="/([[:alnum:]]+)"', 1)[1] AS first_link,
  regexp_extract_all(html, 'href="/([[:alnum:]]+)"', 1)[2] AS second_link,
  CAST(instr(html, '<li>') AS BIGINT) AS pos_li_1,
  CAST(CASE WHEN len(string_split(html, '<li>')) > 3
            THEN length(array_to_string(string_split(html, '<li>')[1:3], '<li>')) + 1
            ELSE 0 END AS BIGINT) AS pos_li_3,
  CAST(CASE WHEN instr(substr(html, 200), '<li>') = 0 THEN 0
            ELSE instr(substr(html, 200), '<li>') + 199 END AS BIGINT) AS pos_li_after_200,
  regexp_full_match(url, 'https://.*') AS is_https,
  list_filter(string_split(url, '/'), lambda x: x <> '')[2] AS host,
  list_filter(regexp_split_to_array(url, '[/?#]'), lambda x: x <> '')[3] AS path_head,
  md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_md5,
  regexp_extract_all(url, '/([[:lower:]]{2})/', 1)[1] AS lang_code
FROM pages
"""

SAFE_RATIOS = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END AS discount_per_tax,
  CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS tax_per_discount,
  CASE WHEN o_totalprice = 0 THEN 0.0 ELSE l_extendedprice / o_totalprice END AS share_of_order,
  round(exp(ln(l_quantity)), 6) AS quantity_roundtrip
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

FUZZY_PART_MATCH = """
SELECT a.p_partkey,
  CAST(levenshtein(a.p_name, a.p_type) AS BIGINT) AS name_type_distance,
  CAST(least(levenshtein(a.p_name, a.p_type), 3) AS BIGINT) AS name_type_distance_cap3,
  CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS next_distance,
  CAST(CASE WHEN b.p_name IS NOT NULL THEN least(levenshtein(a.p_name, b.p_name), 2) END AS BIGINT)
    AS next_distance_cap2
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1
"""

JSON_TYPE_PROFILE = """
WITH docs AS (
  SELECT json_object('props', json(props), 'value', value, 'user_id', user_id, 'event_type', event_type,
                     'tags', json_array(event_type, CAST(user_id AS VARCHAR)), 'ok', event_type <> 'error',
                     'refund', CASE WHEN event_type = 'purchase' THEN value END) AS doc
  FROM events),
kv AS (SELECT unnest(json_keys(doc)) AS key, doc FROM docs)
SELECT key,
  CASE json_type(doc, '$.' || key)
    WHEN 'NULL' THEN 'NULL_VALUE' WHEN 'BOOLEAN' THEN 'BOOLEAN'
    WHEN 'UBIGINT' THEN 'INTEGER' WHEN 'BIGINT' THEN 'INTEGER'
    WHEN 'DOUBLE' THEN 'DECIMAL' WHEN 'VARCHAR' THEN 'VARCHAR'
    WHEN 'ARRAY' THEN 'ARRAY' WHEN 'OBJECT' THEN 'OBJECT' END AS type_name,
  count(*) AS n
FROM kv GROUP BY ALL
"""

ORACLES.update({
    "content_fingerprint": CONTENT_FINGERPRINT,
    "duplicate_groups": DUPLICATE_GROUPS,
    "binary_codecs": BINARY_CODECS,
    "text_shape": TEXT_SHAPE,
    "text_edit": TEXT_EDIT,
    "url_pattern_mining": URL_PATTERN_MINING,
    "safe_ratios": SAFE_RATIOS,
    "fuzzy_part_match": FUZZY_PART_MATCH,
    "json_type_profile": JSON_TYPE_PROFILE,
})

EVENTS_STREAM_LOAD = EVENTS_DECOMPOSED.replace(
    "date_trunc('hour', ts) + INTERVAL 1 HOUR AS insertion_timestamp",
    "TIMESTAMP '2024-02-01 00:00:00' AS insertion_timestamp")

REFRESH_MISSING_FILES = """
SELECT 'c' || lpad(CAST(user_id % 8 AS VARCHAR), 2, '0') AS cell, CAST(ts AS DATE) AS event_date,
       count(*) AS n_rows
FROM events GROUP BY ALL
"""

ORACLES.update({
    "events_stream_load": EVENTS_STREAM_LOAD,
    "refresh_missing_files": REFRESH_MISSING_FILES,
})

_CELL = "'c' || lpad(CAST(user_id % 8 AS VARCHAR), 2, '0')"
_LOAD = "date_trunc('hour', ts) + INTERVAL 1 HOUR"

METADATA_BACKFILL = """
SELECT CAST(event_id AS VARCHAR) AS uuid, event_type,
       CASE WHEN ts < TIMESTAMP '2024-01-08' THEN NULL ELSE CAST(json(props) AS VARCHAR) END AS metadata
FROM events
"""

RETENTION_TRIM = """
SELECT t.table_name, TIMESTAMP '2025-01-15 12:00:00' AS execution_time,
       count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15 12:00:00') AS deleted_records,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15 12:00:00') AS kept_records
FROM events, (VALUES ('sensitive.raw_events'), ('sensitive.events')) AS t(table_name)
GROUP BY t.table_name
"""

TRANSFORM_LAG = f"""
WITH r AS (SELECT {_CELL} AS cell, {_LOAD} AS ins FROM events),
a AS (
  SELECT cell,
         count(*) FILTER (WHERE ins > TIMESTAMP '2024-01-25 00:00:00') AS pending_rows,
         max(ins) FILTER (WHERE ins <= TIMESTAMP '2024-01-25 00:00:00') AS last_consumed,
         min(ins) FILTER (WHERE ins > TIMESTAMP '2024-01-25 00:00:00') AS first_pending
  FROM r GROUP BY cell)
SELECT cell, pending_rows, coalesce(last_consumed, first_pending) AS offset_time,
       CASE WHEN pending_rows > 0
            THEN CAST(date_diff('minute', coalesce(last_consumed, first_pending),
                                TIMESTAMP '2024-01-31 00:00:00') AS DOUBLE)
            ELSE 0.0 END AS lag_minutes
FROM a
"""

REDUCED_EVENTS_VIEW = f"""
SELECT {_LOAD} AS insertion_timestamp, {_CELL} AS cell, CAST(event_id AS VARCHAR) AS uuid,
       'org-' || CAST(user_id AS VARCHAR) AS org_id
FROM events
"""

ORACLES.update({
    "metadata_backfill": METADATA_BACKFILL,
    "retention_trim": RETENTION_TRIM,
    "transform_lag": TRANSFORM_LAG,
    "reduced_events_view": REDUCED_EVENTS_VIEW,
})

TYPED_ROUNDTRIP = """
SELECT CAST(o_orderkey AS DECIMAL(38,0)) AS order_key, CAST(o_custkey AS DECIMAL(10,1)) AS cust_key,
       CAST(o_totalprice AS DECIMAL(20,2)) AS total_price,
       CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DECIMAL(30,3)) AS total_price_3,
       o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS order_date, o_orderdate AS order_ltz_utc,
       -480 AS order_tz_offset_min, o_orderdate AS order_tz_utc, o_orderdate - INTERVAL 480 MINUTE AS order_tz_local,
       (SELECT count(*) FROM orders) AS n_inserted
FROM orders
UNION ALL
SELECT k, c, p, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 3
FROM (VALUES (CAST(-1 AS DECIMAL(38,0)), CAST(7 AS DECIMAL(10,1)), CAST(1 AS DECIMAL(20,2))),
             (-2, 15, 2.55), (-3, NULL, 123.40)) AS v(k, c, p)
"""

# The test tables' columns with the types Spark reads them as.
TABLE_COLUMNS = {
    ("TIDELAKE_STAR", "region"): [("r_regionkey", "int"), ("r_name", "string")],
    ("TIDELAKE_STAR", "nation"): [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    ("TIDELAKE_STAR", "customer"): [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                                    ("c_acctbal", "double"), ("c_mktsegment", "string")],
    ("TIDELAKE_STAR", "supplier"): [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                                    ("s_acctbal", "double")],
    ("TIDELAKE_STAR", "part"): [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
                                ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    ("TIDELAKE_STAR", "orders"): [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                                  ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                                  ("o_orderpriority", "string")],
    ("TIDELAKE_STAR", "lineitem"): [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                                    ("l_linenumber", "int"), ("l_quantity", "double"),
                                    ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                                    ("l_returnflag", "string"), ("l_linestatus", "string"),
                                    ("l_shipdate", "timestamp_ntz")],
    ("TIDELAKE_LAKE", "events"): [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                                  ("event_type", "string"), ("value", "double"), ("props", "string")],
    ("TIDELAKE_LAKE", "documents"): [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                                     ("source", "string"), ("n_chars", "bigint")],
    ("TIDELAKE_LAKE", "embeddings"): [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    ("TIDELAKE_LAKE", "pages"): [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    ("TIDELAKE_LAKE", "benchmark"): [("item_id", "bigint"), ("text", "string")],
    ("TIDELAKE_LAKE", "labels"): [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    ("TIDELAKE_LAKE", "conversations"): [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                                         ("text", "string")],
}


def _column_catalog_sql() -> str:
    parts = []
    for (schema, table), cols in TABLE_COLUMNS.items():
        for pos, (col, typ) in enumerate(cols, start=1):
            parts.append(
                f"SELECT 'SPARK_CATALOG' AS table_catalog, '{schema}' AS table_schema, "
                f"'{table.upper()}' AS table_name, '{col}' AS column_name, {pos} AS ordinal_position, "
                f"'{typ}' AS data_type, count(*) AS row_count, count(*) - count({col}) AS null_count "
                f"FROM {table}")
    return "\nUNION ALL\n".join(parts)


COLUMN_CATALOG = _column_catalog_sql()

SQL_TEMPLATE_JOB = """
SELECT event_type, 'from it''s 2024; ' || event_type AS label, 'it''s 2024' AS window_label,
       count(*) AS n_events, round(sum(value), 2) AS total_value,
       min(ts) AS first_seen, max(ts) AS last_seen
FROM events
WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-01-01'
GROUP BY event_type
"""

ORACLES.update({
    "typed_roundtrip": TYPED_ROUNDTRIP,
    "column_catalog": COLUMN_CATALOG,
    "sql_template_job": SQL_TEMPLATE_JOB,
})


def _passthrough():
    from tidelake.plans.passthrough import QUERIES
    return {name: text for name, (_tables, text) in QUERIES.items()}


ORACLES.update(_passthrough())

METADATA_BACKFILL_APPEND = """
SELECT t.*, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-08') AS n_inserted FROM (
SELECT CAST(event_id AS VARCHAR) AS uuid, event_type, CAST(NULL AS VARCHAR) AS metadata FROM events
UNION ALL
SELECT CAST(NULL AS VARCHAR) AS uuid, CAST(NULL AS VARCHAR) AS event_type, CAST(json(props) AS VARCHAR) AS metadata
FROM events WHERE ts >= TIMESTAMP '2024-01-08') t
"""

REDUCED_RAW_EVENTS_VIEW = f"""
SELECT {_LOAD} AS insertion_timestamp, {_CELL} AS cell, 'org-' || CAST(user_id AS VARCHAR) AS org_id
FROM events
"""

SAFE_RATIO_SUMMARY = """
SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
  round(sum(CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END), 4) AS sum_discount_per_tax,
  sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS n_zero_tax,
  round(exp(avg(ln(l_quantity))), 4) AS geo_mean_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""

ORACLES.update({
    "metadata_backfill_append": METADATA_BACKFILL_APPEND,
    "reduced_raw_events_view": REDUCED_RAW_EVENTS_VIEW,
    "safe_ratio_summary": SAFE_RATIO_SUMMARY,
})

SCALAR_TYPEOF_PROFILE = """
SELECT 'event_id' AS column_name, CASE WHEN event_id IS NULL THEN NULL ELSE 'INTEGER' END AS type_name,
       count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'value', CASE WHEN value IS NULL THEN NULL ELSE 'DOUBLE' END, count(*) FROM events GROUP BY ALL
UNION ALL SELECT 'value_decimal', CASE WHEN value IS NULL THEN NULL ELSE 'DECIMAL' END, count(*) FROM events GROUP BY ALL
UNION ALL SELECT 'event_type', CASE WHEN event_type IS NULL THEN NULL ELSE 'VARCHAR' END, count(*) FROM events GROUP BY ALL
UNION ALL SELECT 'ts', CASE WHEN ts IS NULL THEN NULL ELSE 'TIMESTAMP_NTZ' END, count(*) FROM events GROUP BY ALL
"""

ORACLES.update({"scalar_typeof_profile": SCALAR_TYPEOF_PROFILE})

STREAM_RERUN_GATE = f"""
SELECT s.stage, {_CELL} AS cell, count(*) AS first_run, CAST(0 AS BIGINT) AS rerun_added,
       CAST(0 AS BIGINT) AS new_checkpoint_added
FROM events, (VALUES ('raw'), ('events')) AS s(stage)
GROUP BY ALL
"""

DEFAULT_LOAD_CLOCK = f"""
SELECT {_CELL} AS cell, count(*) AS n_rows, count(*) AS n_zone_roundtrip, count(*) AS n_same_clock,
       CAST(1 AS BIGINT) AS n_load_times
FROM events GROUP BY ALL
"""

# The described table's columns, and the dialect's names for Spark's types.
DESCRIBED = [("N0", "NUMBER(38,0)"), ("N2", "NUMBER(20,2)"), ("I", "NUMBER(38,0)"), ("F4", "FLOAT"), ("F8", "FLOAT"),
             ("T", "VARCHAR"), ("B", "BINARY"), ("FLAG", "BOOLEAN"), ("D", "DATE"), ("NTZ", "TIMESTAMP_NTZ"),
             ("LTZ", "TIMESTAMP_LTZ"), ("TZ", "TIMESTAMP_TZ"), ("ARR", "ARRAY"), ("V", "VARIANT")]
DIALECT_NAMES = {"int": "NUMBER(38,0)", "bigint": "NUMBER(38,0)", "double": "FLOAT", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP_NTZ"}


def _describe_sql() -> str:
    def row(table: str, name: str, type_: str, comment: str, count: str) -> str:
        return (f"SELECT '{table}' AS table_name, '{name}' AS name, '{type_}' AS type, 'COLUMN' AS kind, 'Y' AS null, "
                "CAST(NULL AS VARCHAR) AS \"default\", 'N' AS primary_key, 'N' AS unique_key, "
                "CAST(NULL AS VARCHAR) AS \"check\", CAST(NULL AS VARCHAR) AS expression, "
                f"{comment} AS comment, CAST(NULL AS VARCHAR) AS policy_name, {count}")

    parts = [row("DESCRIBED", n, t, "'any JSON'" if n == "V" else "CAST(NULL AS VARCHAR)", "CAST(0 AS BIGINT) AS non_null")
             for n, t in DESCRIBED]
    parts += [row(table.upper(), c.upper(), DIALECT_NAMES[t], "CAST(NULL AS VARCHAR)", f"count({c}) AS non_null FROM {table}")
              for (schema, table), cols in TABLE_COLUMNS.items() if schema == "TIDELAKE_STAR" for c, t in cols]
    return "\nUNION ALL\n".join(parts)


ORACLES.update({
    "stream_rerun_gate": STREAM_RERUN_GATE,
    "default_load_clock": DEFAULT_LOAD_CLOCK,
    "describe_tables": _describe_sql(),
})

CATALOG_LISTING = "\nUNION ALL\n".join(
    f"SELECT 'tidelake_listing' AS schema_in_use, '{t}' AS table_name, 'the {t} table' AS comment, {len(t)} AS retention_days, "
    f"count(*) AS n_rows, 1 AS times_listed FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))

CHANGE_FEED_INSERTS = """
SELECT o_orderpriority, count(*) AS n_inserted, round(sum(o_totalprice), 2) AS total_price
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
"""

UNKNOWN_TABLE_ERRORS = """
SELECT 'orders' AS table_name, 'OK' AS outcome, count(*) AS n_rows FROM orders
UNION ALL SELECT 'supplier', 'OK', count(*) FROM supplier
UNION ALL SELECT 'no_such_table', 'TABLE_OR_VIEW_NOT_FOUND', NULL
"""

ORACLES.update({
    "catalog_listing": CATALOG_LISTING,
    "change_feed_inserts": CHANGE_FEED_INSERTS,
    "unknown_table_errors": UNKNOWN_TABLE_ERRORS,
})

ORACLES.update({**matching.ORACLES, **profiles.ORACLES})
ORACLES.update({
    "metadata_backfill_late": ORACLES["metadata_backfill"],
    "transform_lag_copartitioned": ORACLES["transform_lag"],
})

_TIME = "CASE WHEN event_type = 'purchase' THEN date_trunc('millisecond', ts) ELSE ts END"

DELETE_BY_PREDICATE = f"""
WITH e AS (SELECT 'org-' || CAST(user_id AS VARCHAR) AS org_id, {_TIME} AS t FROM events),
d AS (SELECT org_id, org_id IN ('org-3', 'org-11') AND t < TIMESTAMP '2024-01-21 09:30:00' AS gone FROM e)
SELECT n.table_name, (SELECT count(*) FROM d WHERE gone) AS returned, org_id, count(*) AS kept_records,
       (SELECT count(*) FROM d WHERE gone) AS deleted_records
FROM d, (VALUES ('raw_events'), ('events')) AS n(table_name) WHERE NOT gone GROUP BY n.table_name, org_id
"""

CHANGE_FEED_EVENTS = f"""
WITH e AS (
  SELECT CAST(event_id AS VARCHAR) AS uuid, event_type, {_LOAD} > TIMESTAMP '2024-01-25 00:00:00' AS late,
         {_TIME} < TIMESTAMP '2024-01-15 12:00:00' AS trimmed,
         CASE WHEN ts < TIMESTAMP '2024-01-08' THEN NULL ELSE CAST(json(props) AS VARCHAR) END AS filled
  FROM events)
SELECT uuid, event_type, 'insert' AS change_type, filled AS metadata FROM e WHERE late
UNION ALL SELECT uuid, event_type, 'delete', NULL FROM e WHERE NOT late AND trimmed
UNION ALL SELECT uuid, event_type, 'update_preimage', NULL FROM e WHERE NOT late AND NOT trimmed AND filled IS NOT NULL
UNION ALL SELECT uuid, event_type, 'update_postimage', filled FROM e WHERE NOT late AND NOT trimmed AND filled IS NOT NULL
"""

ORACLES.update({
    "delete_by_predicate": DELETE_BY_PREDICATE,
    "change_feed_events": CHANGE_FEED_EVENTS,
})
