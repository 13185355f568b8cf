import os
import sys

import duckdb
import pytest

from tidelake.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from oracle_check import TABLES, norm  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_matches_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(norm(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
