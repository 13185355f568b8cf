"""Every registered query against its DuckDB oracle on sf0.001 (the
driver runs the same comparison at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from tidelake.plans.jobs import REGISTRY  # noqa: E402
from oracle_check import TABLES, norm  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(E.queries()) and set(REGISTRY) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["insertion_timestamp", "cell", "uuid"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    # plain, comparable output: unique names, no VARIANT / map / struct columns
    assert len(set(sdf.columns)) == len(sdf.columns)
    assert not [f.name for f in sdf.schema.fields
                if f.dataType.typeName() in ("variant", "map", "struct")], name
    srows, scols = [tuple(r) for r in sdf.collect()], sdf.columns
    rel = duck.sql(E.oracle_sql()[name])
    dcols, drows = rel.columns, rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    so = sorted(range(len(scols)), key=lambda i: scols[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted((tuple(norm(r[i]) for i in so) for r in srows), key=repr)
    b = sorted((tuple(norm(r[i]) for i in do) for r in drows), key=repr)
    assert a == b
