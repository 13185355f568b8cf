"""The jobs a Spark user runs, each over the whole test tables.

Every job takes ``(spark, sf_dir)`` and returns a DataFrame; side effects
(files, tables) go to a fresh folder under the session's shared folder.
"""

from __future__ import annotations

import datetime as _dt
import uuid as _uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidelake.functions as W
from tidelake.operators import catalog, changes, copartition, maintenance, retention
from tidelake.operators.events import (EVENT_COLUMNS_WITH_METADATA, EVENTS_SCHEMA, as_json_text, decompose,
                                       only_inserts)
from tidelake.operators.sqltext import run_sql, run_template
from tidelake.plans import matching, passthrough, profiles
from tidelake.session import run_dir, shared_dir
from tidelake.sources.landing import RAW_SCHEMA, epoch_ntz, event_time, hourly_load_time, landing_records, raw_from_records, write_landing
from tidelake.sources.tables import read_dealt, read_heavy, read_table
from tidelake.streaming import ingest


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events table as an hourly loader would have filled it."""
    records = landing_records(read_dealt(spark, sf_dir, "events"))
    return raw_from_records(records, hourly_load_time(F.col("event_ts")))


def events_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: landing records -> raw VARIANT -> typed events."""
    events = decompose(raw_events(spark, sf_dir), keep_event_date=False)
    return as_json_text(events)


# ---------------------------------------------------------------------------
# Column-function jobs: map-only projections (or a partially aggregated
# groupBy), so every row is handled where it is read and nothing gathers a
# hot key in one task.
# ---------------------------------------------------------------------------


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5 family per document."""
    docs = read_heavy(spark, sf_dir, "documents")
    text = W.to_binary_utf8("text")
    return docs.select(
        "doc_id",
        W.md5("text").alias("md5"),
        F.hex(W.md5_binary(text)).alias("md5_binary_hex"),
        W.md5_number_lower64(text).alias("md5_lower64"),
        W.md5_number_upper64(text).alias("md5_upper64"),
        W.octet_length("text").cast("bigint").alias("n_bytes"),
    )


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-duplicate groups by content hash.  A groupBy with map-side
    partial aggregation: a hash shared by a third of all documents still
    shuffles one partial row per map task, not its documents."""
    docs = read_table(spark, sf_dir, "documents")
    return (docs.groupBy(W.md5("text").alias("md5"))
            .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc_id"),
                 F.sum("n_chars").alias("total_chars"))
            .where(F.col("n_docs") > 1))


def binary_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex and base64 codecs over whole texts, with round-trip checks
    (F15-F22).  Long encodings are reported by their MD5 and length."""
    docs = read_heavy(spark, sf_dir, "documents")
    b = W.to_binary_utf8("text")
    hex_text = W.hex_encode(b)
    b64_text = W.base64_encode(b)
    return docs.select(
        "doc_id",
        W.md5(hex_text).alias("hex_md5"),
        F.length(hex_text).cast("bigint").alias("hex_len"),
        W.md5(b64_text).alias("b64_md5"),
        F.length(b64_text).cast("bigint").alias("b64_len"),
        (W.hex_decode_string(hex_text) == F.col("text")).alias("hex_roundtrip_ok"),
        (W.base64_decode_string(b64_text) == F.col("text")).alias("b64_roundtrip_ok"),
        (F.hex(W.hex_decode_binary(hex_text)) == hex_text).alias("hex_binary_ok"),
        W.bit_length("text").cast("bigint").alias("n_bits"),
    )


def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points, lengths, affixes and positions per document (F1, F3-F6,
    F10, F11, F14-F16) on multilingual text."""
    docs = read_heavy(spark, sf_dir, "documents")
    t = F.col("text")
    return docs.select(
        "doc_id", "lang",
        W.ascii_code(t).cast("bigint").alias("first_code"),
        F.length(t).cast("bigint").alias("n_chars"),
        W.rtrimmed_length(t).cast("bigint").alias("rtrimmed_len"),
        W.octet_length(t).cast("bigint").alias("n_octets"),
        W.left(t, F.lit(12)).alias("prefix"),
        W.right(t, F.lit(12)).alias("suffix"),
        W.charindex(F.lit("the"), t).cast("bigint").alias("pos_the"),
        W.charindex(F.lit("the"), t, F.lit(100)).cast("bigint").alias("pos_the_from_100"),
        W.position(F.lit("é"), t).cast("bigint").alias("pos_e_acute"),
        W.contains(t, F.lit("password")).alias("has_password"),
        W.endswith(t, F.lit(".")).alias("ends_with_period"),
    )


def text_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT, padding, REPEAT, CHR and INITCAP on part names (F2, F9,
    F12, F13, F27)."""
    part = read_table(spark, sf_dir, "part")
    name = F.col("p_name")
    gap = W.charindex(F.lit(" "), name)
    return part.select(
        "p_partkey",
        W.insert(name, gap + 1, F.lit(0), F.concat(F.col("p_type"), F.lit(" "))).alias("typed_name"),
        W.insert(name, F.lit(1), gap - 1, F.upper(F.col("p_brand"))).alias("branded_name"),
        F.concat(name, W.space(F.greatest(F.lit(14) - F.length(name), F.lit(0)))).alias("padded_name"),
        W.repeat(W.left("p_type", F.lit(2)), F.col("p_size") % 4 + 1).alias("type_stamp"),
        W.chr_(F.col("p_size") * 150 + 32).alias("size_glyph"),
        W.initcap(name).alias("title_name"),
    )


def url_pattern_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular-expression functions over whole pages."""
    pages = read_heavy(spark, sf_dir, "pages")
    html, url = F.col("html"), F.col("url")
    link = F.lit('href="/[[:alnum:]]+"')
    return pages.select(
        "page_id",
        F.array_join(W.regexp_substr_all(html, link), " ").alias("links"),
        F.array_join(W.regexp_substr_all(html, link, F.lit(1), F.lit(3)), " ").alias("links_from_3rd"),
        F.array_join(W.regexp_substr_all(html, link, F.lit(500)), " ").alias("links_after_500"),
        W.regexp_substr(html, F.lit('href="/([[:alnum:]]+)"'), F.lit(1), F.lit(1), F.lit(1)).alias("first_link"),
        W.regexp_substr(html, F.lit('href="/([[:alnum:]]+)"'), F.lit(1), F.lit(2), F.lit(1)).alias("second_link"),
        W.regexp_instr(html, F.lit("<li>")).cast("bigint").alias("pos_li_1"),
        W.regexp_instr(html, F.lit("<li>"), F.lit(1), F.lit(3)).cast("bigint").alias("pos_li_3"),
        W.regexp_instr(html, F.lit("<li>"), F.lit(200)).cast("bigint").alias("pos_li_after_200"),
        W.regexp_like(url, F.lit("https://.*")).alias("is_https"),
        W.strtok(url, F.lit("/"), F.lit(2)).alias("host"),
        W.strtok(url, F.lit("/?#"), F.lit(3)).alias("path_head"),
        W.md5(W.regexp_replace(html, F.lit("<[^>]+>"), "")).alias("text_md5"),
        W.regexp_substr(url, F.lit("/([[:lower:]]{2})/"), F.lit(1), F.lit(1), F.lit(1)).alias("lang_code"),
    )


def safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIV0 and EXP/LN per order line (M1-M3).  The line/order join shuffles
    both sides on the order key (sort-merge); AQE may turn it into a
    broadcast only when the order side is measured small enough."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    return j.select(
        "l_orderkey", "l_linenumber",
        W.div0("l_discount", "l_tax").alias("discount_per_tax"),
        W.div0("l_tax", "l_discount").alias("tax_per_discount"),
        W.div0("l_extendedprice", "o_totalprice").alias("share_of_order"),
        F.round(W.exp(W.ln("l_quantity")), 6).alias("quantity_roundtrip"),
    )


def fuzzy_part_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance, plain and capped (F7, F8): each part name against its
    type and against the next part's name.  The neighbour is an equi-join
    on key + 1, so every part meets exactly one partner."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    j = part.join(nxt, "p_partkey", "left")
    return j.select(
        "p_partkey",
        W.editdistance("p_name", "p_type").cast("bigint").alias("name_type_distance"),
        W.editdistance("p_name", "p_type", F.lit(3)).cast("bigint").alias("name_type_distance_cap3"),
        W.editdistance("p_name", "next_name").cast("bigint").alias("next_distance"),
        W.editdistance("p_name", "next_name", F.lit(2)).cast("bigint").alias("next_distance_cap2"),
    )


def json_type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-key JSON type counts over event documents.

    Each event becomes one VARIANT document; ``variant_explode`` lists its
    keys and TYPEOF names each value.  The count per (key, type) is a
    partially aggregated groupBy."""
    ev = read_heavy(spark, sf_dir, "events")
    doc = F.to_json(F.struct(
        F.parse_json("props").alias("props"),
        F.col("value").alias("value"),
        F.col("user_id").alias("user_id"),
        F.col("event_type").alias("event_type"),
        W.array_construct(F.col("event_type"), F.col("user_id").cast("string")).alias("tags"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("refund"),
    ), {"ignoreNullFields": "false"})
    docs = ev.select(F.parse_json(doc).alias("doc"))
    kv = docs.select(F.explode(F.try_variant_get("doc", "$", "map<string,variant>")).alias("key", "value"))
    return (kv.groupBy("key", W.typeof_variant("value").alias("type_name"))
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# Pipeline jobs: they write under a fresh folder of the session's shared
# folder (spark.checkpoint.dir) and return a DataFrame over what they wrote.
# ---------------------------------------------------------------------------


# Fixed clock for the jobs: loads happen at LOAD_TIME; the landing zone is
# split at LATE_DROP_FROM to simulate files whose notification was lost.
LOAD_TIME = _dt.datetime(2024, 2, 1, 0, 0, 0)
LATE_DROP_FROM = _dt.datetime(2024, 1, 20, 0, 0, 0)


def _lit_ts(value: _dt.datetime):
    return F.lit(value).cast("timestamp_ntz")


def events_stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing files -> raw -> events with two ``availableNow`` streams.

    Reruns of both streams then find nothing new (W2)."""
    base = run_dir(spark, "stream-load")
    write_landing(landing_records(read_heavy(spark, sf_dir, "events")), f"{base}/landing")
    ingest.run_once(ingest.start_raw_load(spark, f"{base}/landing", f"{base}/raw", f"{base}/ckpt/raw",
                                          load_time=_lit_ts(LOAD_TIME)))
    ingest.run_once(ingest.start_decompose(spark, f"{base}/raw", f"{base}/events", f"{base}/ckpt/events"))
    events = spark.read.parquet(f"{base}/events")
    return as_json_text(events.select(*EVENT_COLUMNS_WITH_METADATA))


def stream_rerun_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stage and cell, the rows of a first run, what a rerun with
    nothing new adds, and what a rerun with new checkpoints adds (the files
    and load parts are in the ledgers by then)."""
    base = run_dir(spark, "rerun-gate")
    landing, raw, events = f"{base}/landing", f"{base}/raw", f"{base}/events"
    write_landing(landing_records(read_heavy(spark, sf_dir, "events")), landing)

    def run(checkpoint: str) -> None:
        ingest.run_once(ingest.start_raw_load(spark, landing, raw, f"{base}/{checkpoint}/raw", load_time=_lit_ts(LOAD_TIME)))
        ingest.run_once(ingest.start_decompose(spark, raw, events, f"{base}/{checkpoint}/events"))

    def counted(stage: str, path: str, schema: str) -> DataFrame:
        return (spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"))
                .select(F.lit(stage).alias("stage"), "cell", "n_rows"))

    def both() -> DataFrame:
        return counted("raw", raw, RAW_SCHEMA).union(counted("events", events, EVENTS_SCHEMA))

    states = []
    for k, checkpoint in enumerate(("ck1", "ck1", "ck2")):
        run(checkpoint)
        both().write.parquet(f"{base}/counts/{k}")  # two rows per cell
        states.append(spark.read.parquet(f"{base}/counts/{k}").withColumnRenamed("n_rows", f"n{k}"))
    return (states[0].join(states[1], ["stage", "cell"]).join(states[2], ["stage", "cell"])
            .select("stage", "cell", F.col("n0").alias("first_run"), (F.col("n1") - F.col("n0")).alias("rerun_added"),
                    (F.col("n2") - F.col("n1")).alias("new_checkpoint_added")))


def refresh_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed-file refresh (S6, W11): the pipe loads the first drop; the
    late drop lands without a notification; a batch refresh over files
    modified in the last day + 5 minutes loads exactly the missing ones.
    Returns row counts per cell and event date of the raw table."""
    base = run_dir(spark, "refresh")
    records = landing_records(read_heavy(spark, sf_dir, "events"))
    early = records.where(F.col("event_ts") < _lit_ts(LATE_DROP_FROM))
    late = records.where(F.col("event_ts") >= _lit_ts(LATE_DROP_FROM))
    landing, raw = f"{base}/landing", f"{base}/raw"
    write_landing(early, landing)
    ingest.run_once(ingest.start_raw_load(spark, landing, raw, f"{base}/ckpt/raw", load_time=_lit_ts(LOAD_TIME)))
    write_landing(late, landing)
    cutoff = (_dt.datetime.now(_dt.timezone.utc) - _dt.timedelta(days=1, minutes=5)).strftime("%Y-%m-%dT%H:%M:%S")
    ingest.refresh_missed_files(spark, landing, raw, cutoff, load_time=_lit_ts(LOAD_TIME))
    return (spark.read.parquet(raw).groupBy("cell", "event_date")
            .agg(F.count(F.lit(1)).alias("n_rows")))


# ---------------------------------------------------------------------------
# Table maintenance jobs.
# ---------------------------------------------------------------------------


WORK_SCHEMA = "tidelake_work"
INFRA_SCHEMA = "tidelake_infra"
# Retention runs "a year later", at noon, so that one day straddles the cut; the transform lag is observed while the
# copy task has consumed loads up to CONSUMED_UNTIL.
TRIM_AS_OF = _dt.datetime(2025, 1, 15, 12, 0, 0)
CONSUMED_UNTIL = _dt.datetime(2024, 1, 25, 0, 0, 0)
LAG_AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)
LAG_BUCKETS = 8


def _schema(spark: SparkSession, name: str) -> str:
    """A schema whose folder lives under the shared folder."""
    return catalog.create_schema(spark, name, location=f"{shared_dir(spark)}/tidelake/warehouse/{name}.db")


def _table_name(prefix: str) -> str:
    return f"{WORK_SCHEMA}.{prefix}_{_uuid.uuid4().hex[:10]}"


def _raw_table(spark: SparkSession, sf_dir: str, base: str) -> str:
    """The raw events table, written once as event_date-partitioned parquet
    (what the pipe leaves behind); later steps read it like any table."""
    raw_path = f"{base}/raw"
    raw_events(spark, sf_dir).write.mode("overwrite").partitionBy("event_date").parquet(raw_path)
    return raw_path


def _materialize_lake(spark: SparkSession, sf_dir: str, base: str) -> tuple[str, str]:
    """Raw and typed events written as event_date-partitioned parquet."""
    raw_path, events_path = _raw_table(spark, sf_dir, base), f"{base}/events"
    decompose(spark.read.parquet(raw_path)).write.mode("overwrite").partitionBy("event_date").parquet(events_path)
    return raw_path, events_path


def _events_table_with_metadata(spark: SparkSession, raw: DataFrame, base: str) -> str:
    """An events table made before ``metadata`` existed, with the column added later."""
    _schema(spark, WORK_SCHEMA)
    table = _table_name("events")
    maintenance.save_external_table(decompose(raw, with_metadata=False), table, f"{base}/events",
                                    partition_by=["event_date"])
    catalog.add_column(spark, table, "metadata", "VARIANT")
    return table


def metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 with K10: the events table is created before ``metadata``
    existed, the column is added with ALTER TABLE (old rows read NULL), the
    affected partitions are rewritten with the raw records' objects, and the
    table is read back."""
    base = run_dir(spark, "backfill")
    raw = spark.read.parquet(_raw_table(spark, sf_dir, base))
    table = _events_table_with_metadata(spark, raw, base)
    maintenance.write_backfill(spark, f"{base}/events", raw)
    spark.catalog.refreshTable(table)
    return spark.table(table).select("uuid", "event_type", F.to_json("metadata").alias("metadata"))


# Days from which events lost their metadata, and the type of those that did.
LOST_FROM, LOST_TYPE = _dt.date(2024, 1, 20), "purchase"


def metadata_backfill_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 where few events wait: purchases since LOST_FROM lost their
    metadata; only their days are read and rewritten, and only the raw
    records of their keys are shuffled."""
    base = run_dir(spark, "backfill-late")
    raw = spark.read.parquet(_raw_table(spark, sf_dir, base))
    lost = (F.col("event_date") >= F.lit(LOST_FROM)) & (F.col("event_type") == LOST_TYPE)
    (decompose(raw).withColumn("metadata", F.when(~F.coalesce(lost, F.lit(False)), F.col("metadata")))
     .write.partitionBy("event_date").parquet(f"{base}/events"))
    maintenance.write_backfill(spark, f"{base}/events", raw)
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{base}/events").select("uuid", "event_type", F.to_json("metadata").alias("metadata"))


def retention_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9 (W7 + W8 + K15): trim both tables to one year before TRIM_AS_OF,
    record the cleanup history, report deleted and kept rows per table."""
    base = run_dir(spark, "retention")
    raw_path, events_path = _materialize_lake(spark, sf_dir, base)
    _schema(spark, WORK_SCHEMA)
    history = _table_name("sensitive_cleanup_history")
    retention.create_history_table(spark, history, f"{base}/history")
    retention.trim_old_sensitive_data(spark, raw_path, events_path, f"{base}/history", TRIM_AS_OF)
    kept = retention.kept_rows(spark, {"sensitive.raw_events": raw_path, "sensitive.events": events_path})
    return spark.table(history).join(kept, "table_name").select(
        "table_name", "execution_time", F.col("deleted_records").cast("bigint").alias("deleted_records"),
        "kept_records")


# Organisations whose earlier events are deleted on request, and the time before which.
FORGET_ORGS, FORGET_BEFORE = ("org-3", "org-11"), _dt.datetime(2024, 1, 21, 9, 30, 0)


def delete_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 with any predicate: rows of some organisations before a time, from
    raw and typed events; the history, and what is left by organisation."""
    base = run_dir(spark, "delete")
    raw_path, events_path = _materialize_lake(spark, sf_dir, base)
    before = f"timestamp_ntz'{FORGET_BEFORE}'"
    orgs = ", ".join(f"'{o}'" for o in FORGET_ORGS)
    deleted = {
        "raw_events": retention.delete_where(spark, raw_path, F.col("org_id").isin(*FORGET_ORGS) & (event_time(F.col("raw_json")) < F.expr(before)),
                                             record=(f"{base}/history", "raw_events", TRIM_AS_OF)),
        "events": retention.delete_where(spark, events_path, f"org_id IN ({orgs}) AND timestamp < {before}",
                                         record=(f"{base}/history", "events", TRIM_AS_OF))}
    history = spark.read.parquet(f"{base}/history").select("table_name", F.col("deleted_records").cast("bigint").alias("deleted_records"))
    left = None
    for name, path in (("raw_events", raw_path), ("events", events_path)):
        kept = spark.read.parquet(path).groupBy("org_id").agg(F.count(F.lit(1)).alias("kept_records")).select(
            F.lit(name).alias("table_name"), F.lit(deleted[name]).cast("bigint").alias("returned"), "org_id", "kept_records")
        left = kept if left is None else left.union(kept)
    return left.join(history, "table_name")


def change_feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed between the events table before its metadata column,
    and after a trim, a back-fill and the load of late events."""
    base = run_dir(spark, "feed")
    raw = spark.read.parquet(_raw_table(spark, sf_dir, base))
    late = F.col("insertion_timestamp") > _lit_ts(CONSUMED_UNTIL)
    first = decompose(raw.where(~late)).withColumn("metadata", F.lit(None).cast("variant"))
    for version in ("before", "events"):
        first.write.partitionBy("event_date").parquet(f"{base}/{version}")
    retention.trim_partitioned(spark, f"{base}/events", F.col("timestamp"), TRIM_AS_OF.replace(year=TRIM_AS_OF.year - 1))
    maintenance.write_backfill(spark, f"{base}/events", raw)
    decompose(raw.where(late)).write.mode("append").partitionBy("event_date").parquet(f"{base}/events")
    versions = [spark.read.schema(EVENTS_SCHEMA).parquet(f"{base}/{v}") for v in ("before", "events")]
    feed = changes.change_feed(*versions, ["uuid"], "event_date")
    return feed.select("uuid", "event_type", F.col("_change_type").alias("change_type"), F.to_json("metadata").alias("metadata"))


def transform_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6/W12 per cell: the copy task has consumed loads up to
    CONSUMED_UNTIL; lag observed at LAG_AS_OF."""
    raw = spark.read.parquet(_raw_table(spark, sf_dir, run_dir(spark, "lag")))
    events = decompose(raw.where(F.col("insertion_timestamp") <= _lit_ts(CONSUMED_UNTIL)))
    return maintenance.transform_lag(raw, events, as_of=_lit_ts(LAG_AS_OF), by=["cell"])


def transform_lag_copartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lag from key tables that each load leaves bucketed by uuid:
    raw and events meet in a merge join without an exchange on uuid."""
    base = run_dir(spark, "lag-keys")
    raw = spark.read.parquet(_raw_table(spark, sf_dir, base))
    _schema(spark, WORK_SCHEMA)
    raw_table, events_table = _table_name("raw_keys"), _table_name("event_keys")
    consumed = raw.where(F.col("insertion_timestamp") <= _lit_ts(CONSUMED_UNTIL))
    copartition.append_keys(copartition.raw_keys(raw, ["cell"]), raw_table, f"{base}/raw_keys", LAG_BUCKETS)
    copartition.append_keys(copartition.event_keys(decompose(consumed)), events_table, f"{base}/event_keys", LAG_BUCKETS)
    return copartition.copartitioned_lag(spark, raw_table, events_table, as_of=_lit_ts(LAG_AS_OF), by=["cell"])


def reduced_events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal-column views with a comment over catalog tables."""
    base = run_dir(spark, "views")
    raw_path, events_path = _materialize_lake(spark, sf_dir, base)
    _schema(spark, WORK_SCHEMA)
    raw_t, ev_t = _table_name("raw_events"), _table_name("events")
    for name, path in ((raw_t, raw_path), (ev_t, events_path)):
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
        spark.sql(f"REPAIR TABLE {name}")  # register the event_date partitions found on disk
    _schema(spark, INFRA_SCHEMA)
    ev_view, _ = maintenance.create_reduced_views(spark, ev_t, raw_t, INFRA_SCHEMA)
    return spark.table(ev_view)



# ---------------------------------------------------------------------------
# Catalog, typed tables and parameterised SQL.
# ---------------------------------------------------------------------------

STAR_SCHEMA = "tidelake_star"
LAKE_SCHEMA = "tidelake_lake"
STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
LAKE_TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
TZ_OFFSET_MINUTES = -480  # the offset the zoned timestamps are written with

TYPED_ORDERS_DDL = ("order_key DECIMAL(38,0), cust_key DECIMAL(10,1), total_price DECIMAL(20,2), "
                    "total_price_3 NUMERIC(30,3), status VARCHAR(1), priority VARCHAR(15), "
                    f"order_date TIMESTAMP_NTZ, order_ltz TIMESTAMP, order_tz {catalog.TIMESTAMP_TZ}, origin STRING")
# Literal rows of the typed table: key, customer, price (an int, a decimal, a float), and nothing else.
TYPED_LITERALS = [(-1, 7, 1), (-2, 15, "2.55"), (-3, None, 123.4)]


def _utc_wall_clock(instant):
    """An instant as its UTC wall clock, whatever the session's zone."""
    return W.to_utc_ntz(instant.cast("timestamp_ntz"), F.current_timezone())


def _instant(utc_wall_clock):
    """The instant of a UTC wall clock, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch_ntz(), utc_wall_clock))


def typed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types survive a write and read back:
    decimals, local, zoned and plain timestamps.  Rows come from INSERT ..
    SELECT and from literal VALUES; each carries its statement's count."""
    base = run_dir(spark, "typed")
    _schema(spark, WORK_SCHEMA)
    table = _table_name("typed_orders")
    catalog.create_or_replace_table(spark, table, TYPED_ORDERS_DDL, location=f"{base}/typed_orders")
    o = read_table(spark, sf_dir, "orders")
    at = _instant(F.col("o_orderdate"))
    rows = o.select(
        F.col("o_orderkey").cast("decimal(38,0)"), F.col("o_custkey").cast("decimal(10,1)"),
        F.col("o_totalprice").cast("decimal(20,2)"),
        F.col("o_totalprice").cast("decimal(20,2)").cast("decimal(30,3)"),
        F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate"), at,
        F.struct(at.alias("ts"), F.lit(TZ_OFFSET_MINUTES).alias("offset_min")), F.lit("select"))
    selected = catalog.insert(rows, table)
    literals = catalog.insert_values(spark, table, [(*r, "values") for r in TYPED_LITERALS],
                                     ["order_key", "cust_key", "total_price", "origin"])
    back = spark.sql(f"SELECT * FROM {table} ORDER BY order_date ASC NULLS LAST, order_key")
    return back.select(
        "order_key", "cust_key", "total_price", "total_price_3", "status", "priority", "order_date",
        _utc_wall_clock(F.col("order_ltz")).alias("order_ltz_utc"),
        F.col("order_tz.offset_min").alias("order_tz_offset_min"),
        _utc_wall_clock(F.col("order_tz.ts")).alias("order_tz_utc"),
        F.timestamp_add("MINUTE", F.col("order_tz.offset_min"), _utc_wall_clock(F.col("order_tz.ts"))).alias("order_tz_local"),
        F.when(F.col("origin") == "values", literals).otherwise(selected).cast("bigint").alias("n_inserted"))


def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DESC over the given tables and a table of the dialect's types,
    all 11 fields, with each column's rows that are not NULL."""
    typed = f"{WORK_SCHEMA}.described"
    _schema(spark, WORK_SCHEMA)
    base = run_dir(spark, "describe")
    catalog.create_or_replace_table(
        spark, typed, "n0 DECIMAL(38,0), n2 DECIMAL(20,2), i INT NOT NULL, f4 FLOAT, f8 DOUBLE, t VARCHAR(5), "
        f"b BINARY, flag BOOLEAN, d DATE, ntz TIMESTAMP_NTZ, ltz TIMESTAMP, tz {catalog.TIMESTAMP_TZ}, "
        "arr ARRAY<STRING>, v VARIANT COMMENT 'any JSON'", location=f"{base}/typed")
    _schema(spark, STAR_SCHEMA)
    parts = [catalog.describe(spark, typed).select(F.lit("DESCRIBED").alias("table_name"), "*", F.lit(0).cast("bigint").alias("non_null"))]
    for t in STAR_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {STAR_SCHEMA}.{t}")
        spark.sql(f"CREATE TABLE {STAR_SCHEMA}.{t} USING parquet LOCATION '{sf_dir.rstrip('/')}/{t}.parquet'")
        name = f"{STAR_SCHEMA}.{t}"
        counts = catalog.profile(spark, STAR_SCHEMA, t).select(
            F.upper("column_name").alias("name"), (F.col("row_count") - F.col("null_count")).alias("non_null"))
        parts.append(catalog.describe(spark, name).join(counts, "name")
                     .select(F.lit(t.upper()).alias("table_name"), *[F.col(f"`{c}`") for c in catalog.DESCRIBE_COLUMNS], "non_null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.toDF(*[c.replace("?", "").replace(" ", "_") for c in out.columns])


def default_load_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events loaded with the default clock, CONVERT_TIMEZONE('UTC',
    CURRENT_TIMESTAMP): per cell the rows, and those whose load time is one
    single reading that agrees with the clock in another zone."""
    records = landing_records(read_table(spark, sf_dir, "events"))
    raw = raw_from_records(records.drop("event_ts"), W.utc_now())
    tokyo = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), F.col("insertion_timestamp"))
    back = W.to_utc_ntz(tokyo, F.lit("Asia/Tokyo"))
    now = W.utc_now()
    return raw.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(back == F.col("insertion_timestamp"), 1)).alias("n_zone_roundtrip"),
        F.count(F.when(F.col("insertion_timestamp") == now, 1)).alias("n_same_clock"),
        F.countDistinct("insertion_timestamp").alias("n_load_times"))


def column_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column catalog of two schemas (star and
    lake tables, registered over the test files) joined to a one-pass
    profile per table, unioned and ordered."""
    pairs = []
    for schema, tables in ((STAR_SCHEMA, STAR_TABLES), (LAKE_SCHEMA, LAKE_TABLES)):
        _schema(spark, schema)
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{t}")
            spark.sql(f"CREATE TABLE {schema}.{t} USING parquet LOCATION '{sf_dir.rstrip('/')}/{t}.parquet'")
            pairs.append((schema, t))
    cols = catalog.columns(spark, pairs)
    prof = catalog.profile(spark, *pairs[0])
    for p in pairs[1:]:
        prof = prof.unionByName(catalog.profile(spark, *p))
    return (cols.join(prof, ["table_schema", "table_name", "column_name"])
            .orderBy("table_catalog", "table_schema", "table_name", "ordinal_position"))


LISTING_SCHEMA = "tidelake_listing"


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas and tables as the catalog lists them, the
    schema in use, and each table's comment, property and rows."""
    _schema(spark, LISTING_SCHEMA)
    before = catalog.current_schema(spark)
    for t in STAR_TABLES:
        catalog.drop_table(spark, f"{LISTING_SCHEMA}.{t}")
        spark.sql(f"CREATE TABLE {LISTING_SCHEMA}.{t} USING parquet LOCATION '{sf_dir.rstrip('/')}/{t}.parquet' "
                  f"COMMENT 'the {t} table' TBLPROPERTIES ('data_retention_time_in_days' = '{len(t)}')")
    try:
        catalog.use(spark, LISTING_SCHEMA)
        in_use = catalog.current_schema(spark)
        out = None
        for r in catalog.show_tables(spark, in_use).where("NOT isTemporary").collect():  # one row per table
            known = catalog.table_properties(spark, r.tableName)
            one = spark.table(r.tableName).agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(in_use).alias("schema_in_use"), F.lit(r.tableName).alias("table_name"), F.lit(known["comment"]).alias("comment"),
                F.lit(int(known["data_retention_time_in_days"])).alias("retention_days"), "n_rows")
            out = one if out is None else out.unionByName(one)
    finally:
        catalog.use(spark, before)
    listed = [r[0] for r in catalog.show_schemas(spark).collect()].count(in_use)
    return out.withColumn("times_listed", F.lit(listed))


def change_feed_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 on a change feed: the one between orders with those that are
    finished still missing, and orders with the open ones gone and the
    others repriced; only inserts go on."""
    orders = read_table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    before = orders.where(~status.eqNullSafe("F"))
    after = orders.where(~status.eqNullSafe("O")).withColumn(
        "o_totalprice", F.when(status.eqNullSafe("F"), F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1))
    feed = changes.change_feed(before, after, ["o_orderkey"])
    return only_inserts(feed).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_inserted"), F.round(F.sum("o_totalprice"), 2).alias("total_price"))


def unknown_table_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query on a table that does not exist is an error, one on a
    known table counts its rows."""
    out = None
    for name in ("orders", "no_such_table", "supplier"):
        view = f"tidelake_known_{name}"
        if name != "no_such_table":
            read_table(spark, sf_dir, name).createOrReplaceTempView(view)
        try:
            counted = run_sql(spark, f"SELECT count(*) AS n_rows FROM {view}").withColumn("outcome", F.lit("OK"))
        except AnalysisException as e:
            counted = spark.range(1).select(F.lit(None).cast("bigint").alias("n_rows"), F.lit(e.getCondition()).alias("outcome"))
        one = counted.select(F.lit(name).alias("table_name"), "outcome", "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


EVENT_SUMMARY_SCRIPT = """
-- Several statements; the placeholders' values are bound, also inside quotes.
CREATE OR REPLACE TEMPORARY VIEW tidelake_events_window AS
SELECT * FROM tidelake_events_src WHERE ts >= TIMESTAMP_NTZ'2024-01-01';
/* the summary; a semicolon in a quoted string ends nothing */
SELECT event_type, concat('from ${window.label}; ', event_type) AS label, '${window.label}' AS window_label,
       count(*) AS n_events, round(sum(value), 2) AS total_value,
       min(ts) AS first_seen, max(ts) AS last_seen
FROM IDENTIFIER(${events.table})
WHERE ts >= ${window.start} AND ts < ${window_start}
GROUP BY event_type;
"""


def sql_template_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of several statements with ``${key}`` placeholders,
    bound through parameter markers; two keys differ only in a dot."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("tidelake_events_src")
    return run_template(spark, EVENT_SUMMARY_SCRIPT, {
        "events.table": "tidelake_events_window",
        "window.label": "it's 2024",
        "window.start": _dt.datetime(2024, 1, 1),
        "window_start": _dt.datetime(2025, 1, 1),
    })


def metadata_backfill_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10 literally (Q1, K3): ``INSERT INTO events (metadata) SELECT ..``
    adds rows holding only ``metadata``; the events keep theirs empty.  Each
    row of the table read back carries the insert's own count (K2)."""
    base = run_dir(spark, "backfill-append")
    raw = spark.read.parquet(_raw_table(spark, sf_dir, base))
    table = _events_table_with_metadata(spark, raw, base)
    inserted = catalog.insert_select(maintenance.metadata_objects(raw).select("metadata"), table, ["metadata"])
    return spark.table(table).select("uuid", "event_type", F.to_json("metadata").alias("metadata"),
                                     F.lit(inserted).cast("bigint").alias("n_inserted"))


def reduced_raw_events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13 for the raw table: load time, cell and org only."""
    base = run_dir(spark, "raw-view")
    raw_path = _raw_table(spark, sf_dir, base)
    _schema(spark, WORK_SCHEMA)
    raw_t = _table_name("raw_events")
    spark.sql(f"CREATE TABLE {raw_t} USING parquet LOCATION '{raw_path}'")
    spark.sql(f"REPAIR TABLE {raw_t}")
    _schema(spark, INFRA_SCHEMA)
    view = maintenance.create_reduced_view(spark, raw_t, maintenance.RAW_VIEW_COLUMNS,
                                           f"{INFRA_SCHEMA}.non_privileged_raw_events")
    return spark.table(view)


def safe_ratio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M3 aggregated by return flag and line status: DIV0 sums and the
    geometric mean of quantities as EXP(AVG(LN(x))); partial aggregation,
    then one row per flag pair."""
    li = read_table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_returnflag", "l_linestatus")
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.round(F.sum(W.div0("l_discount", "l_tax")), 4).alias("sum_discount_per_tax"),
                 F.sum(F.when(F.col("l_tax") == 0, 1).otherwise(0)).alias("n_zero_tax"),
                 F.round(W.exp(F.avg(W.ln("l_quantity"))), 4).alias("geo_mean_quantity")))



def scalar_typeof_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TYPEOF of typed values (an integer, a decimal, text, a double)
    counted per column over the events table; NULLs have no type."""
    ev = read_table(spark, sf_dir, "events")
    cols = {
        "event_id": F.col("event_id"),
        "value": F.col("value"),
        "value_decimal": F.col("value").cast("decimal(10,2)"),
        "event_type": F.col("event_type"),
        "ts": F.col("ts"),
    }
    typed = ev.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("column_name"),
                 F.when(c.isNotNull(), W.typeof_scalar(c)).alias("type_name"))
        for name, c in cols.items()])).alias("t")).select("t.*")
    return typed.groupBy("column_name", "type_name").agg(F.count(F.lit(1)).alias("n"))


REGISTRY = {
    "events_decompose": events_decompose,
    "content_fingerprint": content_fingerprint,
    "duplicate_groups": duplicate_groups,
    "binary_codecs": binary_codecs,
    "text_shape": text_shape,
    "text_edit": text_edit,
    "url_pattern_mining": url_pattern_mining,
    "safe_ratios": safe_ratios,
    "safe_ratio_summary": safe_ratio_summary,
    "fuzzy_part_match": fuzzy_part_match,
    "json_type_profile": json_type_profile,
    "scalar_typeof_profile": scalar_typeof_profile,
    "events_stream_load": events_stream_load,
    "stream_rerun_gate": stream_rerun_gate,
    "refresh_missing_files": refresh_missing_files,
    "metadata_backfill": metadata_backfill,
    "metadata_backfill_append": metadata_backfill_append,
    "metadata_backfill_late": metadata_backfill_late,
    "retention_trim": retention_trim,
    "delete_by_predicate": delete_by_predicate,
    "change_feed_events": change_feed_events,
    "transform_lag": transform_lag,
    "transform_lag_copartitioned": transform_lag_copartitioned,
    "reduced_events_view": reduced_events_view,
    "reduced_raw_events_view": reduced_raw_events_view,
    "typed_roundtrip": typed_roundtrip,
    "describe_tables": describe_tables,
    "default_load_clock": default_load_clock,
    "catalog_listing": catalog_listing,
    "change_feed_inserts": change_feed_inserts,
    "unknown_table_errors": unknown_table_errors,
    "column_catalog": column_catalog,
    "sql_template_job": sql_template_job,
    **{name: passthrough.job(name) for name in passthrough.QUERIES},
    **matching.QUERIES,
    **profiles.QUERIES,
}
