"""Catalog lifecycle, DESCRIBE, inserts and parameterised SQL."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException

from pyspark.sql import functions as F

from tidelake.operators import catalog
from tidelake.operators.sqltext import bind_template, run_sql, run_template


def test_table_lifecycle(spark, tmp_path):
    catalog.create_schema(spark, "testdb.test1")
    catalog.create_or_replace_table(spark, "testdb_test1.testtable", "a DECIMAL(38,0), b DECIMAL(38,0), c STRING",
                                    location=str(tmp_path / "t"))
    assert catalog.insert_values(spark, "testdb_test1.testtable", [(123, 456, "hello world")], ["a", "b", "c"]) == 1
    assert [tuple(r) for r in spark.table("testdb_test1.testtable").collect()] == [(123, 456, "hello world")]
    catalog.add_column(spark, "testdb_test1.testtable", "metadata", "VARIANT")
    assert catalog.insert_values(spark, "testdb_test1.testtable", [(1,)], ["a"]) == 1
    rows = spark.table("testdb_test1.testtable").orderBy("a").collect()
    assert rows[0].b is None and rows[0].metadata is None
    d = catalog.describe(spark, "testdb_test1.testtable")
    assert d.columns == catalog.DESCRIBE_COLUMNS
    assert [(r.name, r.type) for r in d.collect()] == [
        ("A", "NUMBER(38,0)"), ("B", "NUMBER(38,0)"), ("C", "VARCHAR"), ("METADATA", "VARIANT")]
    assert "testtable" in [r.tableName for r in catalog.show_tables(spark, "testdb_test1").collect()]
    catalog.create_or_replace_table(spark, "testdb_test1.testtable", "x INT", location=str(tmp_path / "t2"))
    assert spark.table("testdb_test1.testtable").count() == 0
    catalog.drop_table(spark, "testdb_test1.testtable")
    catalog.drop_table(spark, "testdb_test1.testtable")  # idempotent


def test_decimal_and_float_types(spark, tmp_path):
    catalog.create_or_replace_table(
        spark, "test_fixed", "num DECIMAL(38,0), num10 DECIMAL(10,1), dec DECIMAL(20,2), numeric DECIMAL(30,3), "
        "int DECIMAL(38,0), integer DECIMAL(38,0)", location=str(tmp_path / "f"))
    # Literals and how each column gives them back.
    literals = ["1.234E2", "15", "9", "1.234E+2", "11", "12"]
    spark.sql(f"INSERT INTO test_fixed SELECT {', '.join(literals)}")
    assert [str(v) for v in spark.table("test_fixed").first()] == ["123", "15.0", "9.00", "123.400", "11", "12"]
    catalog.create_or_replace_table(spark, "test_float", "d DOUBLE, f DOUBLE, dp DOUBLE, r DOUBLE",
                                    location=str(tmp_path / "g"))
    # Float literals.
    spark.sql(f"INSERT INTO test_float SELECT {', '.join(['+1.34', '0.1', '-1.2', '15e-03'])}")
    assert list(spark.table("test_float").first()) == [1.34, 0.1, -1.2, 0.015]


def test_insert_values_take_the_columns_types(spark, tmp_path):
    catalog.create_or_replace_table(spark, "test_literals", "n DECIMAL(20,2), f DOUBLE, i INT, t STRING, at TIMESTAMP_NTZ, flag BOOLEAN",
                                    location=str(tmp_path / "l"))
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(1, 2, 3, "x", at, True), (2.55, 2.5, 4, "y", None, False), (None, None, None, None, None, None)]
    assert catalog.insert_values(spark, "test_literals", rows, ["n", "f", "i", "t", "at", "flag"]) == 3
    got = spark.table("test_literals").orderBy(F.col("n").asc_nulls_last()).collect()
    assert [str(r.n) for r in got] == ["1.00", "2.55", "None"] and [r.f for r in got] == [2.0, 2.5, None]
    assert got[0][2:] == (3, "x", at, True)


def test_insert_select_with_a_column_subset(spark, tmp_path):
    catalog.create_or_replace_table(spark, "test_subset", "a INT, b STRING, c DOUBLE", location=str(tmp_path / "s"))
    assert catalog.insert_select(spark.range(4).selectExpr("id * 1.5D", "CAST(id AS INT)"), "test_subset", ["c", "a"]) == 4
    assert sorted(tuple(r) for r in spark.table("test_subset").collect()) == [(k, None, k * 1.5) for k in range(4)]
    with pytest.raises(ValueError):
        catalog.insert_select(spark.range(1), "test_subset", ["nope"])


def test_unknown_table_is_an_error(spark):
    with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_NOT_FOUND"):
        run_sql(spark, "select * from test_no_such_table")


def test_template_binding(spark):
    text, args = bind_template("SELECT * FROM IDENTIFIER(${t.name}) WHERE x = ${v}", {"t.name": "tbl", "v": 3})
    assert text == "SELECT * FROM IDENTIFIER(:p0_t_name) WHERE x = :p1_v" and args == {"p0_t_name": "tbl", "p1_v": 3}
    with pytest.raises(KeyError):
        bind_template("SELECT ${missing}", {})
    with pytest.raises(ValueError):
        bind_template("SELECT ${broken", {})
    spark.range(5).createOrReplaceTempView("tpl_src")
    assert run_template(spark, "SELECT count(*) FROM IDENTIFIER(${src}) WHERE id >= ${lo}",
                        {"src": "tpl_src", "lo": 2}).first()[0] == 3
    assert run_sql(spark, "SELECT ? + ?", [1, 2]).first()[0] == 3
    with pytest.raises(AnalysisException, match="UNBOUND_SQL_PARAMETER"):
        run_sql(spark, "SELECT :nope", {"other": 1})


def test_templates_keep_keys_and_quotes_apart(spark):
    assert run_template(spark, "SELECT ${a.b}, ${a_b}", {"a.b": 1, "a_b": 2}).first()[:] == (1, 2)
    values = {"p": "it's"}
    assert run_template(spark, "SELECT '${p}/x', 'a ${p}', '${p}', '; -- no', 'it''s'", values).first()[:] == (
        "it's/x", "a it's", "it's", "; -- no", spark.sql("SELECT 'it''s'").first()[0])
    with pytest.raises(ValueError, match="IDENTIFIER"):
        run_template(spark, "SELECT 1 AS `${p}`", values)


def test_scripts_of_several_statements(spark):
    script = """
        -- a comment with ${nothing}; to bind
        CREATE OR REPLACE TEMPORARY VIEW script_src AS SELECT id FROM range(10) WHERE id >= 2;
        /* and ; another */ SELECT count(*) AS n, ';' AS s FROM IDENTIFIER(${src}) WHERE id < ${hi} -- the end
        ;
    """
    assert run_template(spark, script, {"src": "script_src", "hi": 5}).first()[:] == (3, ";")
    with pytest.raises(KeyError):
        run_template(spark, "DROP VIEW IF EXISTS script_src; SELECT ${missing}", {})
    assert spark.catalog.tableExists("script_src")  # nothing ran
    with pytest.raises(ValueError):
        run_template(spark, " ; -- nothing", {})


def test_column_catalog_union_is_ordered(spark):
    from tidelake.plans import jobs
    rows = jobs.column_catalog(spark, "/root/testdata/sf0.001").collect()
    keys = [(r.table_catalog, r.table_schema, r.table_name, r.ordinal_position) for r in rows]
    assert keys == sorted(keys)
    assert {r.table_schema for r in rows} == {"TIDELAKE_STAR", "TIDELAKE_LAKE"}


def test_users_round_trip(spark, tmp_path):
    catalog.create_or_replace_table(
        spark, "users", "insertion_timestamp TIMESTAMP_NTZ, name VARCHAR(20), age INT, is_active BOOLEAN",
        location=str(tmp_path / "u"))
    spark.sql("INSERT INTO users VALUES (timestamp_ntz'2024-05-01 10:00:00', 'joe', 25, false)")
    r = spark.table("users").first()
    assert (r.name, r.age, r.is_active) == ("joe", 25, False)
    # Spark keeps VARCHAR(n) in the table DDL only; reads see STRING
    assert [f.dataType.simpleString() for f in spark.table("users").schema] == [
        "timestamp_ntz", "string", "int", "boolean"]


def test_binary_table_insert(spark, tmp_path):
    catalog.create_or_replace_table(spark, "binary_table", "v STRING, b BINARY, b64_string STRING",
                                    location=str(tmp_path / "b"))
    # A text and its base64 form.
    text, coded = "HELP", "SEVMUA=="
    src = spark.createDataFrame([(text,)], "v string").selectExpr("v", "to_binary(v, 'UTF-8') AS b").selectExpr("*", "base64_encode(b)")
    assert catalog.insert_select(src, "binary_table", ["v", "b", "b64_string"]) == 1
    assert list(spark.table("binary_table").first()) == [text, bytearray(text.encode()), coded]


def test_vartab_insert_from_query_counts_rows(spark, tmp_path):
    catalog.create_or_replace_table(spark, "vartab", "n DECIMAL(2,0), v VARIANT", location=str(tmp_path / "v"))
    # JSON texts.
    texts = ["null", None, "true", "-17", "123.12", "1.912e2", '"Om ara pa ca na dhih"  ', "[-1, 12, 289, 2188, false]",
             '{ "x" : "abc", "y" : false, "z": 10} ']
    src = spark.createDataFrame(list(enumerate(texts, 1)), "n int, t string").selectExpr("n", "parse_json(t) AS v")
    assert catalog.insert(src.selectExpr("CAST(n AS DECIMAL(2,0)) AS n", "v"), "vartab") == 9
    rows = spark.sql("SELECT n, wh_typeof(v) AS t FROM vartab ORDER BY n").collect()
    assert [r.t for r in rows][:3] == ["NULL_VALUE", None, "BOOLEAN"]


def test_information_schema_across_two_databases(spark):
    for db, names in (("testdb", ("left_union", "v", "b", "b64_string")),
                      ("testotherdb", ("right_union", "v2", "b2", "b64_string2"))):
        catalog.create_schema(spark, db)
        t, c1, c2, c3 = names
        catalog.create_or_replace_table(spark, f"{db}.{t}", f"{c1} STRING, {c2} BINARY, {c3} STRING")
    cols = catalog.columns(spark, [("testdb", "left_union"), ("testotherdb", "right_union")])
    rows = cols.where("table_name IN ('LEFT_UNION', 'RIGHT_UNION')") \
        .orderBy("table_catalog", "table_schema", "table_name", "ordinal_position").collect()
    assert [(r.table_schema, r.table_name, r.column_name, r.data_type) for r in rows] == [
        ("TESTDB", "LEFT_UNION", "v", "string"), ("TESTDB", "LEFT_UNION", "b", "binary"),
        ("TESTDB", "LEFT_UNION", "b64_string", "string"),
        ("TESTOTHERDB", "RIGHT_UNION", "v2", "string"), ("TESTOTHERDB", "RIGHT_UNION", "b2", "binary"),
        ("TESTOTHERDB", "RIGHT_UNION", "b64_string2", "string")]


def test_use_and_show(spark):
    catalog.create_schema(spark, "events.infra")
    current = spark.catalog.currentDatabase()
    try:
        catalog.use(spark, "events.infra")
        assert spark.catalog.currentDatabase() == "events_infra"
    finally:
        catalog.use(spark, current)
    assert "events_infra" in [r[0] for r in catalog.show_schemas(spark).collect()]


def test_jdbc_reads_must_be_partitioned(spark):
    from tidelake.sources.tables import read_source
    with pytest.raises(ValueError, match="partitioned"):
        read_source(spark, "jdbc", url="jdbc:mysql://db/x", dbtable="t")


def test_only_inserts_on_a_change_feed(spark):
    from tidelake.operators.events import only_inserts
    feed = spark.createDataFrame([(1, "insert"), (2, "delete"), (3, "update_postimage")], "id int, _change_type string")
    assert [r.id for r in only_inserts(feed).collect()] == [1]
    plain = spark.range(3)
    assert only_inserts(plain) is plain


def test_read_source_parquet_and_landing_scan_window(spark, tmp_path):
    import datetime as dt
    import json

    from tidelake.sources.landing import scan_landing
    from tidelake.sources.tables import read_source

    df = read_source(spark, "parquet", "/root/testdata/sf0.001/region.parquet")
    assert df.count() == 5 and df.columns == ["r_regionkey", "r_name"]
    land = tmp_path / "landing" / "cell=z9"
    land.mkdir(parents=True)
    (land / "a.json").write_text(json.dumps({"uuid": "1", "org_id": "o"}) + "\n")
    scanned = scan_landing(spark, str(tmp_path / "landing")).collect()
    assert len(scanned) == 1 and "cell=z9/" in scanned[0].source_file
    later = (dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=1)).strftime("%Y-%m-%dT%H:%M:%S")
    assert scan_landing(spark, str(tmp_path / "landing"), modified_after=later).count() == 0


def test_recursion_joined_to_many_rows_sorts_none_of_them(spark, tmp_path):
    """The chain's few keys leave most of 200 shuffle partitions empty."""
    from tidelake.plans import passthrough

    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(100).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(10_000).select((F.col("id") % 100).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = passthrough.run(spark, str(tmp_path), "pt_recursive_line_chain")
        assert {tuple(r) for r in df.collect()} == {(k + 1, 400) for k in range(25)}
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
