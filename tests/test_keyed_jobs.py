"""Jobs that meet by keys: the back-fill's runtime filter, the lag's bucketed key tables."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelake.operators import copartition, keyfilter, maintenance


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("blocks", [1, 64])
def test_filter_loses_no_wanted_key(spark, blocks):
    rnd = random.Random(1)
    keys = [f"k{rnd.randrange(100000)}" for _ in range(3000)]
    wanted = spark.createDataFrame([(k,) for k in keys[:300]] + [(None,)], "uuid string")
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "uuid string, i int")
    left = {r.i for r in keyfilter.may_match(rows, ["uuid"], keyfilter.key_filter(wanted, ["uuid"], blocks), blocks).collect()}
    due = {i for i, k in enumerate(keys) if k in set(keys[:300])}
    assert due <= left and len(left) <= len(due) + (60 if blocks == 1 else 5)
    empty = keyfilter.key_filter(wanted.where("false"), ["uuid"], blocks)
    assert keyfilter.may_match(rows, ["uuid"], empty, blocks).count() == 0


def raw_rows(spark, n=400):
    rows = [(f"u{k}", f'{{"uuid":"u{k}","metadata":{{"v":{k}}}}}', dt.date(2024, 1, 1 + k % 20) if k % 50 else None, dt.datetime(2024, 2, 1)) for k in range(n)]
    return (spark.createDataFrame(rows, "u string, text string, event_date date, insertion_timestamp timestamp_ntz")
            .select("event_date", "insertion_timestamp", F.parse_json("text").alias("raw_json")))


def test_fill_shuffles_due_records_only(spark, tmp_path):
    raw_rows(spark).write.partitionBy("event_date").parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    events = raw.select(F.variant_get("raw_json", "$.uuid", "string").alias("uuid"), "event_date").select(
        "uuid", "event_date", F.when(~F.col("uuid").isin("u3", "u7", "u50", "u100"), F.parse_json(F.lit("{}"))).alias("metadata"))
    fill = maintenance.due_fill(events, raw, f"{tmp_path}/fill")
    got = {(r.uuid, r.event_date, r.m) for r in fill.select("uuid", "event_date", F.to_json("metadata").alias("m")).collect()}
    assert got == {(f"u{k}", dt.date(2024, 1, 1 + k % 20) if k % 50 else None, f'{{"v":{k}}}') for k in (3, 7, 50, 100)}
    need = events.where("metadata is null and uuid is not null").select("event_date", "uuid")
    records = keyfilter.may_match(maintenance.metadata_objects(raw.where(maintenance._on_days([dt.date(2024, 1, 4)]))), ["uuid"],
                                  keyfilter.key_filter(need, ["uuid"]))
    plan = plan_of(records)
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan)
    # The records stay where they are read; only the filter's bitmaps are exchanged.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and set(re.findall(r"hashpartitioning\((\w+)#", plan)) == {"filter_block"}
    assert records.count() == 1


def test_lag_meets_without_an_exchange(spark, tmp_path):
    raw = raw_rows(spark).withColumn("cell", F.lit("a"))
    extra = spark.createDataFrame([(None, None, dt.datetime(2024, 2, 2), "b")], "t string, event_date date, insertion_timestamp timestamp_ntz, cell string")
    raw = raw.unionByName(extra.select("event_date", "insertion_timestamp", "cell", F.parse_json(F.coalesce("t", F.lit('{"x":1}'))).alias("raw_json")))
    uuid = F.variant_get("raw_json", "$.uuid", "string")
    events = raw.select(uuid.alias("uuid"), "event_date").where("uuid is not null and uuid not in ('u1', 'u2', 'u3')")
    names = "copart_raw", "copart_events"
    try:
        for part in (F.col("event_date") < dt.date(2024, 1, 10), F.coalesce(F.col("event_date") >= dt.date(2024, 1, 10), F.lit(True))):  # two loads
            copartition.append_keys(copartition.raw_keys(raw.where(part), ["cell"]), names[0], f"{tmp_path}/r", 4)
            copartition.append_keys(copartition.event_keys(events.where(part)), names[1], f"{tmp_path}/e", 4)
        as_of = F.lit(dt.datetime(2024, 2, 3)).cast("timestamp_ntz")
        for since in (None, dt.date(2024, 1, 3)):
            lag = copartition.copartitioned_lag(spark, *names, as_of=as_of, by=["cell"], since=since)
            want = maintenance.transform_lag(raw, events, as_of=as_of, by=["cell"], since=since)
            assert sorted(map(tuple, lag.collect())) == sorted(map(tuple, want.collect()))
            plan = plan_of(lag)
            assert "SortMergeJoin" in plan and "hashpartitioning(uuid" not in plan and plan.count("hashpartitioning(cell") == plan.count("hashpartitioning") and "Bucketed: true" in plan
        assert {r.cell: r.pending_rows for r in lag.collect()} == {"a": 2, "b": 1}
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def events_table(spark, path, n):
    """Events in a file of one row group, as the test tables have it."""
    (spark.range(0, n, 1, 1).select(F.col("id").alias("event_id"), F.expr("timestampadd(SECOND, cast(id as int), timestamp_ntz'2024-01-01 00:00:00')").alias("ts"),
                                    (F.col("id") % 100).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 1}').alias("props"))
     .write.parquet(f"{path}/events.parquet"))


def test_rows_of_few_row_groups_are_dealt(spark, tmp_path):
    from tidelake.plans import jobs
    from tidelake.sources.tables import TASK_ROWS, read_dealt

    n = 4 * TASK_ROWS
    events_table(spark, f"{tmp_path}/large", n)
    raw = jobs.raw_events(spark, f"{tmp_path}/large")
    dealt = [r[0] for r in raw.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    want = min(4, spark.sparkContext.defaultParallelism)
    assert len(dealt) == want and sum(dealt) == n and max(dealt) <= 1.25 * n / want
    assert raw.select(F.expr("variant_get(raw_json, '$.uuid', 'string')")).distinct().count() == n
    # few rows, none, and even splits are left where they are
    for name, rows in (("small", 100), ("none", 0)):
        events_table(spark, f"{tmp_path}/{name}", rows)
        df = read_dealt(spark, f"{tmp_path}/{name}", "events")
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == rows
    spark.read.parquet(f"{tmp_path}/large/events.parquet").repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(f"{tmp_path}/even/events.parquet")
    assert read_dealt(spark, f"{tmp_path}/even", "events").count() == n
