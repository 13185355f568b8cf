"""Positions of matches, replacement text and indented JSON, against brute force."""
import json
import random
import re

import pytest
from pyspark.sql import functions as F

import tidelake.functions as W


def matches(s, p, position):
    """All matches of a walk from ``position`` (from 1) that sees what lies before."""
    return [m for m in re.compile(p).finditer(s, max(position, 1) - 1)] if position <= len(s) + 1 else []


PATTERNS = ["x*", "X", "(?<=b)2", "a|", "b+", "aa", "(a)(b)?", r"\b", "$", "[0-9]{2}", "é.", "(?<=a)a", "c(?=d)"]
TEXTS = ["abc", "aXbXc", "a1b2", "", "aaaa", "ab aab b", "é漢éé", "12345", "a\nb\nc", "cdcd\ufdd0cd", "xx"]


def test_positions_equal_a_walk_over_the_matches(spark):
    rows = [(s, p, k, n) for s in TEXTS for p in PATTERNS for k in (0, 1, 2, 3, 5, 9) for n in (1, 2, 3)]
    df = spark.createDataFrame(rows, "s string, p string, k int, n int").repartition(8)
    got = {(r.s, r.p, r.k, r.n): (r["at"], r["found"], r["count"]) for r in df.select(
        "*", F.expr("wh_regexp_instr(s, p, k, n)").alias("at"), F.expr("wh_regexp_substr(s, p, k, n)").alias("found"),
        F.expr("wh_regexp_count(s, p, k)").alias("count")).collect()}
    for s, p, k, n in rows:
        all_of = matches(s, p, k)
        m = all_of[n - 1] if len(all_of) >= n else None
        assert got[s, p, k, n] == (m.start() + 1 if m else 0, m.group() if m else None, len(all_of)), (s, p, k, n)


def test_positions_keep_nulls_and_captures(spark):
    row = spark.sql("SELECT wh_regexp_instr(NULL, 'a') a, wh_regexp_instr('a', NULL) b, wh_regexp_instr('a1b2', '(?<=b)2', 4, 1) c, "
                    "wh_regexp_substr('k=1 k=2 k=3', '(k)=([0-9])', 4, 2, 2) d, regexp_substr_all('a1_a2a3', 'a[[:digit:]]', 2) e").first()
    assert tuple(row) == (None, None, 4, "3", ["a2", "a3"])


@pytest.mark.parametrize("s, p, r, want", [
    ("price 5", "5", "$", "price $"), ("ab", "(a)(b)", r"\2\1", "ba"), ("ab", "(a)", r"\12", "a2b"), ("ab", "a", r"\\", r"\b"), ("ab", "a", "x\\", "x\\b"),
    ("ab", "(a)", r"$1\1", "$1ab"), ("ab", "a", r"\$", "$b"), ("a-b", "-", r"\d", r"a\db"), ("aaa", "x*", "-", "-a-a-a-"), ("ab", "b", "", "a"), ("ab", "(a)", r"\\1", r"\1b")])
def test_replacement_text(spark, s, p, r, want):
    df = spark.createDataFrame([(s, p, r)], "s string, p string, r string")
    assert df.select(F.expr("wh_regexp_replace(s, p, r)")).first()[0] == want


def test_whole_numbers_of_any_length_are_integers(spark):
    kinds = spark.sql("""SELECT wh_typeof(parse_json('12345678901234567890')) a, wh_typeof(parse_json('-9223372036854775809')) b,
                         wh_typeof(parse_json('1.5')) c, wh_typeof(parse_json('123456789012345678901.5')) d, wh_typeof(parse_json('7')) e""").first()
    assert tuple(kinds) == ("INTEGER", "INTEGER", "DECIMAL", "DECIMAL", "INTEGER")


def some_json(rnd, depth=0):
    kind = rnd.randrange(9 if depth < 6 else 6)
    if kind < 6:
        return rnd.choice([None, True, -17, 2.5, "", "plain", 'quote " and \\ back', "{[,:]}", "line\nbreak\ttab", "é漢😀", "\\\"", "ends in \\"])
    if kind == 6:
        return [some_json(rnd, depth + 1) for _ in range(rnd.randrange(5))]
    return {rnd.choice(["a", "b:", 'c"', "{", "é", "z\\"]) + str(k): some_json(rnd, depth + 1) for k in range(rnd.randrange(5))}


def test_indented_json(spark):
    rnd = random.Random(3)
    values = [some_json(rnd) for _ in range(300)] + [[], {}, [[]], {"a": {}}, [list(range(2000))], {"k": [{"x": [1, {"y": "}" * 700}]}] * 200}]
    df = spark.createDataFrame([(json.dumps(v, ensure_ascii=False),) for v in values], "t string").select(F.parse_json("t").alias("v"))
    for row, value in zip(df.select(W.indented_json("v").alias("out"), F.to_json("v").alias("compact")).collect(), values, strict=True):
        assert row.out == json.dumps(json.loads(row.compact), indent=2, ensure_ascii=False) and json.loads(row.out) == value
    assert spark.sql("SELECT indented_json(CAST(NULL AS VARIANT))").first()[0] is None


def test_indented_json_as_asserted(spark):
    texts = ["null", "true", "-17", "123.12", '"Om ara pa ca na dhih"', "[-1, 12, 289, 2188, false]", '{"x": "abc", "y": false, "z": 10}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(W.indented_json(F.parse_json("t"))).collect()]
    assert got == ["null", "true", "-17", "123.12", '"Om ara pa ca na dhih"', "[\n  -1,\n  12,\n  289,\n  2188,\n  false\n]",
                   '{\n  "x": "abc",\n  "y": false,\n  "z": 10\n}']


def test_indented_json_of_few_row_groups_is_shared_out(spark, tmp_path):
    """One row group is one task's; its rows are dealt before each becomes text and is read back."""
    from tidelake.plans import profiles
    from tidelake.sources.tables import TASK_ROWS

    spark.range(0, 4 * TASK_ROWS, 1, 1).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), (F.col("id") % 9).alias("user_id"),
                                               F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    got = profiles.indented_json_events(spark, str(tmp_path))
    n, back = got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count_if("reads_back").alias("back")).agg(F.count(F.lit(1)), F.sum("back")).first()
    assert n == min(4, spark.sparkContext.defaultParallelism) and back == 4 * TASK_ROWS
