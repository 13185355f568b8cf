"""Landing -> raw -> events: streams, idempotence, refresh, retention,
back-fill, lag."""

import datetime as dt
import json
import os
import shutil
import time
import tempfile

import pytest
from pyspark.sql import functions as F

from tidelake.operators import maintenance, retention
from tidelake.operators.events import EVENT_COLUMNS_WITH_METADATA, EVENTS_SCHEMA, as_json_text, decompose
from tidelake.plans import jobs
from tidelake.sources.landing import (RAW_SCHEMA, enrich, hourly_load_time, landing_records, raw_from_records,
                                      scan_landing, write_landing)
from tidelake.sources.tables import read_table
from tidelake.streaming import ingest, publish
from tidelake.util import list_files

SF = "/root/testdata/sf0.001"
LOAD = dt.datetime(2024, 2, 1)


def lit_ts(v):
    return F.lit(v).cast("timestamp_ntz")


@pytest.fixture()
def work():
    return tempfile.mkdtemp(prefix="tidelake-test-")


def landed(spark, work):
    records = landing_records(read_table(spark, SF, "events"))
    write_landing(records, f"{work}/landing")
    return records


def test_stream_equals_batch_and_rerun_is_empty(spark, work):
    records = landed(spark, work)
    n_raw = ingest.run_once(ingest.start_raw_load(spark, f"{work}/landing", f"{work}/raw", f"{work}/ck/raw",
                                                  load_time=lit_ts(LOAD)))
    n_ev = ingest.run_once(ingest.start_decompose(spark, f"{work}/raw", f"{work}/events", f"{work}/ck/ev"))
    total = records.count()
    assert n_raw > 0 and n_ev > 0
    assert spark.read.parquet(f"{work}/raw").count() == total
    assert spark.read.parquet(f"{work}/events").count() == total
    # Nothing new -> both streams read zero rows and add nothing
    assert ingest.run_once(ingest.start_raw_load(spark, f"{work}/landing", f"{work}/raw", f"{work}/ck/raw",
                                                 load_time=lit_ts(LOAD))) == 0
    assert ingest.run_once(ingest.start_decompose(spark, f"{work}/raw", f"{work}/events", f"{work}/ck/ev")) == 0
    streamed = as_json_text(spark.read.parquet(f"{work}/events").select(*EVENT_COLUMNS_WITH_METADATA))
    batch = as_json_text(decompose(raw_from_records(records, lit_ts(LOAD)), keep_event_date=False))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_replayed_loads_are_idempotent(spark, work):
    landed(spark, work)
    files = ingest.list_landing_files(spark, f"{work}/landing")
    first = ingest.load_files(spark, files, f"{work}/raw", lit_ts(LOAD))
    assert first == read_table(spark, SF, "events").count()
    assert ingest.load_files(spark, files, f"{work}/raw", lit_ts(LOAD)) == 0
    assert ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw") == 0
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{work}/raw")
    assert raw.count() == first
    assert ingest.append_events(raw, f"{work}/events") == first
    assert ingest.append_events(raw, f"{work}/events") == 0
    assert spark.read.parquet(f"{work}/events").count() == first


def test_backlog_larger_than_a_batch_or_a_trigger(spark, work):
    n = 23
    for k in range(n):
        write(work, f"cell=c{k}", [{"uuid": f"u{k}", "timestamp": "2024-01-10T08:00:00"}])
    assert ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", files_per_batch=4) == n
    assert ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", files_per_batch=4) == 0
    raw_files = len(list_files(spark, f"{work}/raw", ".parquet"))
    query = ingest.start_decompose(spark, f"{work}/raw", f"{work}/events", f"{work}/ck", max_files_per_trigger=2)
    ingest.run_once(query)
    assert raw_files > 2 and spark.read.parquet(f"{work}/events").count() == n


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_refresh_loads_only_missing_files(spark, work, zone):
    write(work, "cell=a", [{"uuid": "u1", "timestamp": "2024-01-10T08:00:00"}])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ingest.run_once(ingest.start_raw_load(spark, f"{work}/landing", f"{work}/raw", f"{work}/ck", load_time=lit_ts(LOAD)))
        now = dt.datetime.now(dt.timezone.utc)
        for name, hours in (("new", 0), ("day", 20), ("old", 30)):
            path = write(work, f"cell={name}", [{"uuid": name, "timestamp": "2024-01-10T08:00:00"}])
            at = (now - dt.timedelta(hours=hours)).timestamp()
            os.utime(path, (at, at))
        since = (now - dt.timedelta(days=1, minutes=5)).strftime("%Y-%m-%dT%H:%M:%S")
        assert ingest.refresh_missed_files(spark, f"{work}/landing", f"{work}/raw", since) == 2
        assert ingest.refresh_missed_files(spark, f"{work}/landing", f"{work}/raw", since) == 0
        assert {r.cell for r in spark.read.schema(RAW_SCHEMA).parquet(f"{work}/raw").collect()} == {"a", "new", "day"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_refresh_waits_for_a_running_load(spark, work):
    write(work, "cell=a", [{"uuid": "u1", "timestamp": "2024-01-10T08:00:00"}])
    root = publish.work_root(f"{work}/raw")
    with publish.writer(spark, root):  # the pipe is loading
        with pytest.raises(TimeoutError):
            ingest.refresh_missed_files(spark, f"{work}/landing", f"{work}/raw", "2000-01-01T00:00:00", wait=0.2)
    assert ingest.refresh_missed_files(spark, f"{work}/landing", f"{work}/raw", "2000-01-01T00:00:00") == 1
    # a lock that nobody has refreshed for the lease belongs to a dead writer
    os.makedirs(root, exist_ok=True)
    lock = f"{root}/{publish.LOCK}"
    open(lock, "w").close()
    os.utime(lock, (1, 1))
    assert ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw") == 0


def test_a_writer_that_wakes_up_after_a_takeover(spark, work):
    """It may not publish, and it leaves the new writer's lock alone."""
    root, target = publish.work_root(f"{work}/raw"), f"{work}/raw"
    lock = f"{root}/{publish.LOCK}"
    first = publish.writer(spark, root)
    first.__enter__()
    slept = publish._HELD[root]
    late = publish.Publication(spark, root, publish.new_batch("late"))
    spark.range(3).write.parquet(late.stage("rows"))
    os.utime(lock, (1, 1))
    with publish.writer(spark, root, wait=5) as settled:
        assert settled == {late.batch: "discarded"}
        fresh = publish._HELD[root]
        publish._HELD[root] = slept  # the first process goes on
        spark.range(3).write.parquet(late.stage("rows"))
        with pytest.raises(publish.LostLease):
            late.commit({"rows": target})
        first.__exit__(None, None, None)
        assert open(lock).read() == fresh.owner and not os.path.exists(target)
        with pytest.raises(TimeoutError):
            publish.Lease(spark, root, 600).take(0.2)
        publish._HELD[root] = fresh
        own = publish.Publication(spark, root, publish.new_batch("own"))
        spark.range(40, numPartitions=20).write.parquet(own.stage("rows"))  # enough files for a pool
        own.commit({"rows": target})
        publish._HELD.pop(root)
    assert spark.read.parquet(target).count() == 40 and not os.path.exists(lock)
    with publish.writer(spark, root) as settled:
        assert settled == {late.batch: "discarded"}
    assert spark.read.parquet(target).count() == 40


def test_a_lease_that_cannot_be_refreshed_is_lost(spark, work, monkeypatch):
    root = publish.work_root(f"{work}/raw")
    with monkeypatch.context() as m, pytest.raises(publish.LostLease):
        with publish.writer(spark, root, lease=0.4):
            m.setattr(publish, "write_text", lambda *a: 1 / 0)
            time.sleep(0.5)
            m.undo()
            publish.Publication(spark, root, publish.new_batch("x")).commit({})


def test_a_takeover_gives_back_a_lock_made_meanwhile(spark, work):
    root = publish.work_root(f"{work}/raw")
    with publish.writer(spark, root):
        alive = publish._HELD[root]
        publish.Lease(spark, root, 600)._bury("the name of a dead writer")
        alive.check()


class Crash(Exception):
    pass


def crash_at(monkeypatch, name, when):
    """Make a step of a publication die at its ``when``-th call (from 1); returns the number of calls made so far."""
    real, calls = getattr(publish, name), []

    def step(*args, **kwargs):
        calls.append(args)
        if len(calls) == when:
            raise Crash
        return real(*args, **kwargs)

    monkeypatch.setattr(publish, name, step)
    return calls


@pytest.mark.parametrize("step, when, committed", [("write_text", 1, False), ("_move", 1, False), ("_move", 2, True), ("_move", 3, True),
                                                   ("_move", 4, True)])
def test_crash_in_a_load_leaves_all_or_nothing(spark, work, monkeypatch, step, when, committed):
    """One landing file of several dates: its rows go to several folders."""
    rows = [{"uuid": f"u{k}", "timestamp": f"2024-01-{10 + k}T08:00:00"} for k in range(3)]
    write(work, "cell=a", rows)
    with monkeypatch.context() as m:
        crash_at(m, step, when)
        with pytest.raises(Crash):
            ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", lit_ts(LOAD))
    again = ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", lit_ts(LOAD))
    assert again == (0 if committed else 3)
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{work}/raw")
    assert sorted(r.uuid for r in decompose(raw).collect()) == ["u0", "u1", "u2"]


@pytest.mark.parametrize("when", [1, 2, 3])
def test_crash_in_the_copy_task_leaves_all_or_nothing(spark, work, monkeypatch, when):
    write(work, "cell=a", [{"uuid": f"u{k}", "timestamp": f"2024-01-{10 + k}T08:00:00"} for k in range(3)])
    ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", lit_ts(LOAD))
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{work}/raw")
    with monkeypatch.context() as m:
        crash_at(m, "_move", when)
        with pytest.raises(Crash):
            ingest.append_events(raw, f"{work}/events")
    ingest.append_events(raw, f"{work}/events")
    assert sorted(r.uuid for r in spark.read.parquet(f"{work}/events").collect()) == ["u0", "u1", "u2"]


def test_malformed_lines_are_rescued(spark, work):
    path = write(work, "cell=a", [{"uuid": "u1", "timestamp": "-9223372036854775808"}])
    with open(path, "a") as fh:
        fh.write("\n{broken\n\n   \n[1, 2]\n")
    assert ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", lit_ts(LOAD)) == 3
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{work}/raw")
    assert [r.rescued_text for r in raw.where("rescued_text IS NOT NULL").collect()] == ["{broken"]
    events = decompose(raw).collect()
    assert sorted(r.uuid or "" for r in events) == ["", "", "u1"]
    lag = maintenance.transform_lag(raw, decompose(raw), as_of=lit_ts(LOAD)).first()
    assert lag.pending_rows == 2  # rows without a uuid match nothing


def write(work, folder, rows, name="f.json"):
    os.makedirs(f"{work}/landing/{folder}", exist_ok=True)
    path = f"{work}/landing/{folder}/{name}"
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows))
    return path


def fixture_records(spark, work):
    """The shapes FIXTURES.md asks for, as landing files."""
    recs = {
        "cell=ab12": [
            {"uuid": "u1", "timestamp": "2024-01-10T08:00:00", "org_id": "o1", "metadata": {"a": 1}},
            {"uuid": "u2", "timestamp": "1705276800000", "org_id": "o1", "metadata": [{"a": 1}]},  # epoch ms
            {"uuid": "u3", "org_id": "o2", "actor": "not-an-object"},  # missing time
            {"uuid": "u4", "timestamp": "2024-01-15T00:00:00.5", "org_id": "o2"},  # just after the cut
            {"uuid": "u5", "timestamp": "2024-01-14T23:59:59.999", "org_id": "o2", "metadata": {"b": 2}},
            {"uuid": "u7", "timestamp": "2024-01-15T18:00:00", "org_id": "o2"},
        ],
        "nocell": [{"uuid": "u6", "timestamp": "2024-01-20T00:00:00", "org_id": "o3"}],
    }
    for folder, rows in recs.items():
        os.makedirs(f"{work}/landing/{folder}", exist_ok=True)
        with open(f"{work}/landing/{folder}/f.json", "w") as fh:
            fh.write("\n".join(json.dumps(r) for r in rows))
    return sum(len(r) for r in recs.values())


def test_fixture_shapes_decompose(spark, work):
    n = fixture_records(spark, work)
    raw = enrich(scan_landing(spark, f"{work}/landing"), lit_ts(LOAD))
    ev = {r.uuid: r for r in as_json_text(decompose(raw)).collect()}
    assert len(ev) == n
    assert ev["u1"].cell == "ab12" and ev["u6"].cell is None  # path without cell=
    assert ev["u2"].timestamp == dt.datetime(2024, 1, 15, 0, 0, 0)
    assert ev["u3"].timestamp is None and ev["u3"].actor is None  # non-object actor -> NULL
    assert ev["u1"].metadata == '{"a":1}' and ev["u2"].metadata is None  # arrays are not objects


def test_trim_keeps_null_times_and_counts_add_up(spark, work):
    fixture_records(spark, work)
    raw = enrich(scan_landing(spark, f"{work}/landing"), lit_ts(LOAD))
    raw.write.partitionBy("event_date").parquet(f"{work}/raw")
    decompose(spark.read.parquet(f"{work}/raw")).write.partitionBy("event_date").parquet(f"{work}/events")
    total = spark.read.parquet(f"{work}/raw").count()
    # 2024-01-15 12:00 UTC as epoch milliseconds (raw) and as ISO text (events)
    deleted = retention.trim_sensitive_raw_events(spark, f"{work}/raw", "1705320000000", f"{work}/hist")
    deleted_ev = retention.trim_sensitive_events(spark, f"{work}/events", "2024-01-15 12:00:00", f"{work}/hist")
    left = {r.uuid for r in decompose(spark.read.parquet(f"{work}/raw")).collect()}
    left_ev = {r.uuid for r in spark.read.parquet(f"{work}/events").collect()}
    # u1, u5: whole partitions dropped; u2, u4: boundary partition rewritten
    assert deleted == 4 and deleted_ev == 4
    assert left == left_ev == {"u3", "u6", "u7"}  # u3 has no time and is never trimmed
    assert total == deleted + len(left)
    hist = spark.read.parquet(f"{work}/hist").collect()
    assert sorted((r.table_name, int(r.deleted_records)) for r in hist) == [
        ("sensitive.events", 4), ("sensitive.raw_events", 4)]
    # a new task, and one that had consumed nothing before the trim, see every row that is left
    ingest.run_once(ingest.start_decompose(spark, f"{work}/raw", f"{work}/ev2", f"{work}/ck2"))
    assert {r.uuid for r in spark.read.parquet(f"{work}/ev2").collect()} == {"u3", "u6", "u7"}
    # the same trim again finds nothing and says so
    assert retention.trim_sensitive_raw_events(spark, f"{work}/raw", "1705320000000", f"{work}/hist") == 0
    assert spark.read.parquet(f"{work}/hist").count() == 3


def lake_with_a_boundary_day(spark, work):
    """Three dates loaded and consumed, then one more row for the boundary day that is not consumed yet."""
    write(work, "cell=a", [{"uuid": "old", "timestamp": "2024-01-10T08:00:00"}, {"uuid": "gone", "timestamp": "2024-01-15T08:00:00"},
                           {"uuid": "keep", "timestamp": "2024-01-15T18:00:00"}, {"uuid": "later", "timestamp": "2024-01-20T08:00:00"}])
    ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", lit_ts(LOAD))
    ingest.run_once(ingest.start_decompose(spark, f"{work}/raw", f"{work}/events", f"{work}/ck"))
    write(work, "cell=b", [{"uuid": "new", "timestamp": "2024-01-15T19:00:00"}])
    ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", lit_ts(LOAD))


def raw_uuids(spark, work):
    return sorted(r.uuid for r in decompose(spark.read.schema(RAW_SCHEMA).parquet(f"{work}/raw")).collect())


def test_rows_not_yet_consumed_survive_a_trim(spark, work):
    lake_with_a_boundary_day(spark, work)
    assert retention.trim_sensitive_raw_events(spark, f"{work}/raw", "2024-01-15 12:00:00", f"{work}/hist") == 2
    assert raw_uuids(spark, work) == ["keep", "later", "new"]
    assert ingest.stream_lag(spark, f"{work}/raw", f"{work}/events", lit_ts(LOAD)).first().pending_parts == 1
    for checkpoint in ("ck", "ck-new"):  # the running task, and one made anew
        ingest.run_once(ingest.start_decompose(spark, f"{work}/raw", f"{work}/events", f"{work}/{checkpoint}"))
        got = sorted(r.uuid for r in spark.read.parquet(f"{work}/events").collect())
        assert got == ["gone", "keep", "later", "new", "old"]
    assert ingest.stream_lag(spark, f"{work}/raw", f"{work}/events", lit_ts(LOAD)).first().pending_parts == 0


TRIM_CRASHES = [("write_text", 1, False), ("_move", 1, False), ("_move", 2, True), ("_move", 3, True),
                ("delete_path", 1, True), ("delete_path", 2, True), ("delete_path", 3, True)]


@pytest.mark.parametrize("step, when, committed", TRIM_CRASHES)
def test_crash_in_a_trim(spark, work, monkeypatch, step, when, committed):
    """Wherever a trim dies, the table stays readable, no kept row is missing, and the next writer
    settles it: rows and history agree."""
    lake_with_a_boundary_day(spark, work)
    before = raw_uuids(spark, work)
    with monkeypatch.context() as m:
        crash_at(m, step, when)
        with pytest.raises(Crash):
            retention.trim_sensitive_raw_events(spark, f"{work}/raw", "2024-01-15 12:00:00", f"{work}/hist")
        if step == "delete_path":  # half of a removal: a crash in the middle of deleting a folder's files
            for f in list_files(spark, f"{work}/raw/event_date=2024-01-10", ".parquet")[:1]:
                os.remove(f"{work}/raw/event_date=2024-01-10/{f}")
    # anyone can read meanwhile, with and without a schema; what must stay is there
    assert {"keep", "later", "new"} <= set(raw_uuids(spark, work)) <= set(before)
    assert {"keep", "later", "new"} <= {r.uuid for r in decompose(spark.read.parquet(f"{work}/raw")).collect()}
    deleted = retention.trim_sensitive_raw_events(spark, f"{work}/raw", "2024-01-15 12:00:00", f"{work}/hist")
    assert deleted == (0 if committed else 2)
    assert raw_uuids(spark, work) == ["keep", "later", "new"]
    assert sum(int(r.deleted_records) for r in spark.read.parquet(f"{work}/hist").collect()) == 2
    ingest.run_once(ingest.start_decompose(spark, f"{work}/raw", f"{work}/events", f"{work}/ck"))
    assert sorted(r.uuid for r in spark.read.parquet(f"{work}/events").collect()) == ["gone", "keep", "later", "new", "old"]


def test_one_year_before_is_epoch_millis_text():
    assert retention.one_year_before(dt.datetime(2025, 1, 15)) == "1705276800000"
    assert retention.one_year_before(dt.datetime(2024, 2, 29)) == str(
        int((dt.datetime(2023, 2, 28) - dt.datetime(1970, 1, 1)).total_seconds() * 1000))


def test_backfill_keyed_and_append(spark):
    raw = raw_from_records(landing_records(read_table(spark, SF, "events")), hourly_load_time(F.col("event_ts")))
    events = decompose(raw, with_metadata=False).withColumn("metadata", F.lit(None).cast("variant"))
    keyed = maintenance.backfill_metadata(events, raw, "keyed")
    appended = maintenance.backfill_metadata(events, raw, "append")
    n, n_obj = events.count(), maintenance.metadata_fill(raw).count()
    assert keyed.count() == n and keyed.where(F.col("metadata").isNotNull()).count() == n_obj
    assert appended.count() == n + n_obj
    assert appended.where(F.col("uuid").isNull()).count() == n_obj


def test_backfill_takes_one_record_per_event(spark, work):
    """Two raw records of one uuid do not double its event; the one loaded last wins; only dates in need are rewritten."""
    day = "2024-01-10T08:00:00"
    write(work, "cell=a", [{"uuid": "x", "timestamp": day, "metadata": {"v": 1}}, {"timestamp": day, "metadata": {"v": 9}},
                           {"uuid": "y", "timestamp": "2024-01-11T08:00:00"}])
    ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", lit_ts(LOAD))
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{work}/raw")
    ingest.append_events(raw, f"{work}/events", with_metadata=False)
    write(work, "cell=b", [{"uuid": "x", "timestamp": day, "metadata": {"v": 2}}])
    ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw", lit_ts(LOAD + dt.timedelta(hours=1)))
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{work}/raw")
    untouched = list_files(spark, f"{work}/events/event_date=2024-01-11", ".parquet")
    assert maintenance.write_backfill(spark, f"{work}/events", raw) == 1
    stored = spark.read.schema(EVENTS_SCHEMA).parquet(f"{work}/events")
    assert sorted((r.uuid or "", r.metadata) for r in as_json_text(stored).collect()) == [("", None), ("x", '{"v":2}'), ("y", None)]
    assert list_files(spark, f"{work}/events/event_date=2024-01-11", ".parquet") == untouched
    assert maintenance.write_backfill(spark, f"{work}/events", raw) == 0
    # the rewritten rows are still known as consumed; only the late record is new
    assert ingest.append_events(raw, f"{work}/events") == 1


def test_lag_zero_when_nothing_pending_and_earliest_pending_when_nothing_consumed(spark):
    raw = raw_from_records(landing_records(read_table(spark, SF, "events")), hourly_load_time(F.col("event_ts")))
    as_of = lit_ts(dt.datetime(2024, 2, 1))
    caught_up = maintenance.transform_lag(raw, decompose(raw), as_of=as_of).first()
    assert caught_up.pending_rows == 0 and caught_up.lag_minutes == 0.0
    nothing = maintenance.transform_lag(raw, decompose(raw.where("false")), as_of=as_of).first()
    first_load = raw.agg(F.min("insertion_timestamp")).first()[0]
    assert nothing.offset_time == first_load
    assert nothing.lag_minutes == (dt.datetime(2024, 2, 1) - first_load).total_seconds() // 60


def test_job_registry_runs_pipeline_jobs(spark):
    out = jobs.retention_trim(spark, SF).collect()
    by = {r.table_name: r for r in out}
    total = read_table(spark, SF, "events").count()
    for r in by.values():
        assert int(r.deleted_records) + r.kept_records == total


def test_ledgers_are_compacted(spark, work):
    for k in range(3):
        write(work, f"cell=c{k}", [{"uuid": f"u{k}", "timestamp": "2024-01-10T08:00:00"}])
        ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw")
    ledger = ingest.files_path(f"{work}/raw")
    assert len(list_files(spark, ledger, ".parquet")) == 3
    assert ingest.compact_ledger(spark, f"{work}/raw", ledger, ingest.FILES_SCHEMA) == 1
    assert len(list_files(spark, ledger, ".parquet")) == 1
    assert ingest.read_ledger(spark, ledger, ingest.FILES_SCHEMA).count() == 3
    assert ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw") == 0


def test_old_ledger_days_are_not_read(spark, work, monkeypatch):
    """Each load matches its names with the days whose filter may hold them only, and loads no file twice."""
    days = [dt.date(2024, 3, 1 + k) for k in range(3)]
    for k, day in enumerate(days):
        monkeypatch.setattr(ingest, "_today", lambda d=day: d)
        write(work, f"cell=c{k}", [{"uuid": f"u{k}", "timestamp": "2024-01-10T08:00:00"}])
        files = ingest.list_landing_files(spark, f"{work}/landing/cell=c{k}")
        assert ingest.load_files(spark, files, f"{work}/raw") == 1

    def read_days(cell):
        names = ingest.list_landing_files(spark, f"{work}/landing/cell={cell}").select(
            ingest.normalize_path(F.col("path")).alias("source_file"))
        ledger = ingest.ledger_for(spark, f"{work}/raw", names)
        return sorted(r.load_day for r in ledger.select("load_day").distinct().collect())  # load_day names folders

    assert [read_days(f"c{k}") for k in range(3)] == [[d] for d in days]
    write(work, "cell=new", [{"uuid": "new", "timestamp": "2024-01-10T08:00:00"}])
    assert read_days("new") == []
    merged = ingest.compact_ledger(spark, f"{work}/raw", ingest.filter_path(f"{work}/raw"), ingest.FILTER_SCHEMA, merge=ingest.merged_filters)
    assert merged == 0  # one file a day
    # a ledger from before there were filters gets them
    shutil.rmtree(ingest.filter_path(f"{work}/raw"))
    assert ingest.load_landing_batch(spark, f"{work}/landing", f"{work}/raw") == 1
    assert [read_days(f"c{k}") for k in range(3)] == [[d] for d in days]


def test_a_backlog_is_dealt_once(spark, work, monkeypatch):
    """Fifty batches: the names are written in folders once, each batch reads its own."""
    names = [f"file:/landing/{k}.json" for k in range(400)]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    dealt, loaded = [], []
    real = ingest._dealt

    def watched(spark_, listing, batches):
        for own in real(spark_, listing, batches):
            dealt.append(set(own.inputFiles()))
            yield own

    monkeypatch.setattr(ingest, "_dealt", watched)
    monkeypatch.setattr(ingest, "_load_batch", lambda spark_, root, own, *_: loaded.append(own) or len(own))
    assert ingest.load_files(spark, files, f"{work}/raw", files_per_batch=8) == 400
    assert 40 <= len(dealt) <= 50 and sum(map(len, dealt)) == len(set().union(*dealt))
    assert sorted(n for own in loaded for n in own) == sorted(names)


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace as N

    from tidelake.session import shared_dir

    none = N(get=lambda *_: None)
    fake = N(conf=none, sparkContext=N(getConf=lambda: none, master="spark://host:7077",
                                       _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))))
    with pytest.raises(RuntimeError):
        shared_dir(fake)


def test_old_run_folders_are_purged(spark):
    from tidelake.session import purge_runs, run_dir

    old, new = run_dir(spark, "purge-old"), run_dir(spark, "purge-new")
    for folder in (old, new):
        spark.range(1).write.parquet(folder)
    local = old.removeprefix("file:")
    os.utime(local, (1, 1))
    assert os.path.basename(old) in purge_runs(spark, 1.0)
    assert not os.path.exists(local) and spark.read.parquet(new).count() == 1
