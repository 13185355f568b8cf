"""The EventLake procedures end to end on fixture landing files."""

import datetime as dt
import json
import os
import tempfile

from tidelake.plans.pipeline import EventLake


def write_files(folder, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"f{len(os.listdir(folder))}.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows))


def test_event_lake_round(spark):
    work = tempfile.mkdtemp(prefix="tidelake-lake-")
    lake = EventLake(spark, landing=f"{work}/landing", root=f"{work}/lake")
    write_files(f"{work}/landing/cell=c1", [
        {"uuid": "a", "timestamp": "2023-01-01T00:00:00", "org_id": "o", "metadata": {"k": 1}},
        {"uuid": "b", "timestamp": "2024-06-01T00:00:00", "org_id": "o", "metadata": [{"k": 1}]},
    ])
    lake.run_once()
    assert lake.events().count() == 2
    assert lake.lag_minutes(as_of=dt.datetime(2024, 7, 1)).first().lag_minutes == 0.0
    # a late file nobody told the pipe about
    write_files(f"{work}/landing/cell=c2", [{"uuid": "c", "timestamp": "2024-06-02T00:00:00", "org_id": "p"}])
    assert lake.refresh() == 1
    pending = lake.lag_minutes(as_of=dt.datetime(2030, 1, 1)).first()
    assert pending.pending_rows == 1 and pending.lag_minutes > 0
    by_files = lake.stream_lag_minutes(as_of=dt.datetime(2030, 1, 1)).first()
    assert by_files.pending_parts == 1 and by_files.lag_minutes == pending.lag_minutes
    assert by_files.offset_time == pending.offset_time
    lake.run_once()  # the stream sees c2 too, but the ledger already has it
    assert lake.raw().count() == 3 and lake.events().count() == 3
    caught_up = lake.stream_lag_minutes(as_of=dt.datetime(2030, 1, 1)).first()
    assert caught_up.pending_parts == 0 and caught_up.lag_minutes == 0.0
    trimmed = lake.trim(as_of=dt.datetime(2024, 3, 1))
    assert trimmed == {"sensitive.raw_events": 1, "sensitive.events": 1}
    ev_view, raw_view = lake.create_views("lake_infra")
    assert sorted(r.uuid for r in spark.table(ev_view).collect()) == ["b", "c"]
    assert spark.table(raw_view).columns == ["insertion_timestamp", "cell", "org_id"]
    assert lake.backfill_metadata() == 0  # the array-shaped metadata is not an object
    assert {r.uuid: r.metadata for r in lake.events().collect()}["b"] is None
    assert lake.compact_ledgers() > 0 and lake.compact_ledgers() == 0
    lake.run_once()
    assert lake.refresh() == 0 and lake.raw().count() == 2 and lake.events().count() == 2


def test_periodic_trigger_picks_up_new_files(spark):
    import time
    work = tempfile.mkdtemp(prefix="tidelake-live-")
    lake = EventLake(spark, landing=f"{work}/landing", root=f"{work}/lake")
    write_files(f"{work}/landing/cell=c1", [{"uuid": "x1", "timestamp": "2024-06-01T00:00:00", "org_id": "o"}])
    q = lake.load(available_now=False)
    try:
        deadline = time.time() + 90
        write_files(f"{work}/landing/cell=c2", [{"uuid": "x2", "timestamp": "2024-06-02T00:00:00", "org_id": "o"}])
        while time.time() < deadline:
            q.processAllAvailable()
            if os.path.exists(lake.raw_path) and lake.raw().count() == 2:
                break
            time.sleep(1)
        assert lake.raw().count() == 2
        assert q.isActive
    finally:
        q.stop()


def test_fully_trimmed_tables_stay_readable(spark):
    work = tempfile.mkdtemp(prefix="tidelake-empty-")
    lake = EventLake(spark, landing=f"{work}/landing", root=f"{work}/lake")
    write_files(f"{work}/landing/cell=c1", [{"uuid": "old", "timestamp": "2020-01-01T00:00:00", "org_id": "o"}])
    lake.run_once()
    assert lake.trim(as_of=dt.datetime(2024, 1, 1)) == {"sensitive.raw_events": 1, "sensitive.events": 1}
    assert lake.raw().count() == 0 and lake.events().count() == 0
    assert lake.trim(as_of=dt.datetime(2024, 1, 2)) == {"sensitive.raw_events": 0, "sensitive.events": 0}
    assert lake.stream_lag_minutes(as_of=dt.datetime(2024, 1, 2)).first().lag_minutes == 0.0
    assert lake.lag_minutes(as_of=dt.datetime(2024, 1, 2)).first().pending_rows == 0
