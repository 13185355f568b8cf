"""The change feed between versions, and deletes by any predicate."""
import datetime as dt
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from tidelake.operators import changes, retention
from tidelake.util import list_files

SCHEMA = "k string, d date, v int, `a.b` string, n array<int>"


def versions(seed):
    rnd = random.Random(seed)

    def row(k):
        return k, rnd.choice([dt.date(2024, 1, 1 + rnd.randrange(6)), None]), rnd.choice([1, 2, None]), rnd.choice(["", None, "x|y", "-"]), rnd.choice([[1], [], None, [1, 2]])

    before = [row(rnd.choice([f"k{i}", f"k{i}", None])) for i in range(80)] + [("same", dt.date(2024, 1, 9), 1, "a", [1])] * 3
    after = [r for r in before if r[0] == "same" or rnd.random() > 0.2]
    after = [(*r[:2], *row("")[2:]) if rnd.random() < 0.3 and r[0] != "same" else r for r in after] + [row(f"new{i}") for i in range(10)] + before[:4]
    return before, after


def plain(rows):
    return Counter((r[0], r[1], r[2], r[3], None if r[4] is None else tuple(r[4])) for r in rows)


def test_feed_leads_from_one_version_to_the_other(spark):
    for seed in range(3):
        old, new = versions(seed)
        before, after = (spark.createDataFrame(v, SCHEMA).repartition(3) for v in (old, new))
        for date in ("d", None):
            feed = changes.change_feed(before, after, ["k"], date).collect()
            by = {t: [r for r in feed if r["_change_type"] == t] for t in ("insert", "delete", "update_preimage", "update_postimage")}
            gone, came = by["delete"] + by["update_preimage"], by["insert"] + by["update_postimage"]
            assert plain(gone) == plain(old) - plain(new) and plain(came) == plain(new) - plain(old)
            # pairs: as many updates of a key as both sides allow
            lost, got = (Counter(r[0] for r in rows) for rows in (gone, came))
            want = Counter({k: min(lost[k], got[k]) for k in lost if got[k]})
            assert Counter(r[0] for r in by["update_preimage"]) == Counter(r[0] for r in by["update_postimage"]) == want
    assert changes.change_feed(before, before, ["k"], "d").count() == 0


def test_unchanged_dates_are_not_compared(spark):
    old, new = versions(1)
    before, after = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    want = {r[1] for r in (plain(old) - plain(new)) + (plain(new) - plain(old))}
    assert set(changes.changed_dates(before, after, "d")) == want and dt.date(2024, 1, 9) not in want


def test_delete_rewrites_only_files_with_a_match(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = [(i, f"org-{i % 5}" if i % 7 else None, dt.date(2024, 1, 1 + i % 3) if i % 11 else None) for i in range(200)]
    spark.createDataFrame(rows, "i int, org string, event_date date").repartitionByRange(4, "i").write.partitionBy("event_date").parquet(path)
    files = set(list_files(spark, path, ".parquet"))
    hit = {os.path.relpath(r[0].removeprefix("file:").replace("//", "/"), path)
           for r in spark.read.parquet(path).where("org = 'org-2' and i < 60").select(F.input_file_name()).distinct().collect()}
    gone = retention.delete_where(spark, path, "org = 'org-2' AND i < 60", record=(f"{tmp_path}/history", "t", dt.datetime(2025, 1, 1)))
    kept = [r for r in rows if not (r[1] == "org-2" and r[0] < 60)]
    assert gone == len(rows) - len(kept)
    assert sorted(r.i for r in spark.read.parquet(path).collect()) == sorted(r[0] for r in kept)
    now = set(list_files(spark, path, ".parquet"))
    assert 0 < len(hit) < len(files) and files - hit <= now and not hit & now
    # nothing matches: nothing is written; NULL keeps; a whole table may go
    assert retention.delete_where(spark, path, "org = 'nobody'") == 0 and set(list_files(spark, path, ".parquet")) == now
    assert retention.delete_where(spark, path, F.col("org").isNotNull() | F.lit(None)) == sum(r[1] is not None for r in kept)
    assert {r.org for r in spark.read.parquet(path).collect()} == {None}
    assert retention.delete_where(spark, path, "true") == sum(r[1] is None for r in kept)
    assert not list_files(spark, path, ".parquet") and retention.delete_where(spark, path, "true") == 0
    assert [int(r.deleted_records) for r in spark.read.parquet(f"{tmp_path}/history").collect()] == [gone]


def test_changes_do_not_pass_through_the_driver(spark, tmp_path):
    """Rows wide with VARIANTs, which make Spark guess the few columns of a change tiny."""
    def version(n, text):
        return spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit(dt.date(2024, 1, 1)).alias("d"),
                                     *[F.parse_json(F.concat(F.lit(f'{{"{text}": '), "id", F.lit("}"))).alias(f"v{i}") for i in range(8)])

    for name, text in (("before", "a"), ("after", "b")):
        version(30_000, text).write.parquet(f"{tmp_path}/{name}")
    feed = changes.change_feed(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("before", "after")], ["k"], "d")
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2
    # only the filters, whose size does not grow with the changes
    assert plan.count("BroadcastHashJoin") == plan.count("bitmap_construct_agg") // 2 == 2
    assert {r[0]: r[1] for r in feed.groupBy(changes.CHANGE_TYPE).count().collect()} == {"update_preimage": 30_000, "update_postimage": 30_000}
