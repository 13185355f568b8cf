"""Golden rows for every asserted scalar: SQL form and DataFrame form."""

import datetime as dt
import decimal
import math

import pytest
from pyspark.sql import functions as F

import tidelake.functions as W


def one(spark, sql):
    return list(spark.sql(sql).collect()[0])


def check(spark, function, cases):
    """Each case: arguments and the expected value, all in one row of literals."""
    row = spark.range(1).select(*[function(*[F.lit(a) for a in args]).alias(f"c{k}") for k, (args, _) in enumerate(cases)])
    assert list(row.first()) == [want for _, want in cases]


def test_ascii(spark):
    df = spark.sql("SELECT * FROM VALUES ('!'), ('A'), ('a'), ('bcd'), (''), (NULL) AS t(column1)")
    got = [r[1] for r in df.select("column1", W.ascii_code("column1")).collect()]
    assert got == [33, 65, 97, 98, 0, None]


def test_chr(spark):
    df = spark.sql("SELECT * FROM VALUES (83), (33), (169), (8364), (0), (NULL) AS t(column1)")
    got = [r[1] for r in df.select("column1", W.chr_("column1")).collect()]
    assert got == ["S", "!", "©", "€", "\x00", None]
    assert one(spark, "SELECT wh_chr(8364)") == ["€"]


# Needle, text and start, and the position that must come out.
CHARINDEX = [(("ban", "banana", 1), 1), (("an", "banana", 1), 2), (("an", "banana", 3), 4),
             (("nope", "banana", 1), 0), (("nope", "banana", 3), 0)]


def test_charindex_position(spark):
    check(spark, W.charindex, CHARINDEX)
    check(spark, W.position, [(args[:2], want) for args, want in CHARINDEX if args[2] == 1])
    assert one(spark, "SELECT charindex('ban', 'banana') + position('an' IN 'banana')") == [3]


def test_contains_endswith(spark):
    # Fixed values.
    check(spark, W.contains, [(("banana", "bana"), True), (("banana", "nope"), False)])
    check(spark, W.endswith, [(("banana", "nana"), True), (("banana", "an"), False)])


def test_div0(spark):
    # A, b and their quotient.
    cases = [((1, 2), 0.5), ((1, 0), 0), ((1, None), None)]
    df = spark.createDataFrame([args for args, _ in cases], "a int, b int")
    assert [r[0] for r in df.select(W.div0("a", "b")).collect()] == [want for _, want in cases]
    df.createOrReplaceTempView("div0_cases")
    assert [r[0] for r in spark.sql("SELECT div0(a, b) FROM div0_cases").collect()] == [want for _, want in cases]


def test_div0_keeps_decimals(spark):
    big = "12345678901234567.89"
    df = spark.sql(f"SELECT CAST('{big}' AS DECIMAL(20,2)) AS a, CAST(1 AS DECIMAL(2,0)) AS b, CAST(0 AS DECIMAL(2,0)) AS z")
    got = df.select(W.div0("a", "b"), W.div0("a", "z"), W.div0(F.lit(None).cast("decimal(20,2)"), F.col("z"))).first()
    assert got[0] == decimal.Decimal(big) and got[1] == 0 and got[2] is None
    assert one(spark, f"SELECT div0_number({big}, 1), div0_number(1, 0)") == [decimal.Decimal(big), 0]


def test_editdistance(spark):
    # Two texts, the cap, and the distance.
    a, b = "Gute nacht", "Ich weis nicht"
    check(spark, W.editdistance, [((a, b), 8), ((a, b, 3), 3), ((a, b, 20), 8)])
    spark.createDataFrame([(a, b)], "a string, b string").createOrReplaceTempView("distances")
    assert one(spark, "SELECT editdistance(b, a, max_distance => 3) FROM distances") == [3]


def test_exp_ln(spark):
    e, e10 = one(spark, "SELECT EXP(1), EXP(LN(10))")
    assert math.isclose(e, 2.718281828459045, rel_tol=1e-15)
    assert math.isclose(e10, 10.000000000000002, rel_tol=1e-15)


def test_hex(spark):
    # Text and its hex digits.
    for text, digits in (("HELLO", "48454C4C4F"), ("Snowflake", "536E6F77666C616B65")):
        check(spark, lambda t: W.hex_encode(W.to_binary_utf8(t)), [((text,), digits)])
        check(spark, W.hex_decode_binary, [((digits,), bytearray(text.encode()))])
        check(spark, W.hex_decode_string, [((digits,), text)])


def test_base64(spark):
    # Text and its base64 form.
    for text, coded in (("HELP", "SEVMUA=="), ("Snowflake", "U25vd2ZsYWtl")):
        check(spark, W.to_binary_utf8, [((text,), bytearray(text.encode()))])
        check(spark, lambda t: W.base64_encode(W.to_binary_utf8(t)), [((text,), coded)])
        check(spark, W.base64_decode_string, [((coded,), text)])
    # long input: no CRLF whatever spark.sql.chunkBase64String.enabled says
    long = one(spark, "SELECT base64_encode(CAST(repeat('x', 300) AS BINARY))")[0]
    assert "\r" not in long and "\n" not in long


def test_base64_roundtrip_property(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=20, deadline=None)
    @given(st.text(max_size=200))
    def check(s):
        df = spark.createDataFrame([(s,)], "s string")
        got = df.select(W.base64_decode_string(W.base64_encode(W.to_binary_utf8("s"))),
                        W.hex_decode_string(W.hex_encode(W.to_binary_utf8("s")))).first()
        assert got[0] == s and got[1] == s

    check()


def test_bit_octet_length(spark):
    df = spark.sql("SELECT * FROM VALUES ('abc', CAST(NULL AS BINARY)), (NULL, X'A1B2') AS bl(v, b)")
    rows = df.orderBy(F.col("v").asc_nulls_last()).select(
        "v", "b", W.bit_length("v"), W.bit_length("b")).collect()
    assert [list(r) for r in rows] == [["abc", None, 24, None], [None, bytearray(b"\xa1\xb2"), None, 16]]
    assert one(spark, "SELECT octet_length('abc'), octet_length(X'A1B2')") == [3, 2]


def test_insert(spark):
    # Text, position, length, insertion, and the result.
    check(spark, W.insert, [
        (("abc", 1, 2, "Z"), "Zc"), (("abcdef", 3, 2, "zzz"), "abzzzef"), (("abc", 2, 1, ""), "ac"), (("abc", 4, 0, "Z"), "abcZ"),
        ((None, 1, 2, "Z"), None), (("abc", None, 2, "Z"), None), (("abc", 1, None, "Z"), None), (("abc", 1, 2, None), None)])


def test_left_right_repeat_space_rtrim(spark):
    # Fixed values.
    check(spark, W.left, [(("ABCDEF", 3), "ABC")])
    check(spark, W.right, [(("ABCDEFG", 3), "EFG")])
    check(spark, W.repeat, [(("xy", 5), "xy" * 5)])
    check(spark, W.space, [((4,), " " * 4)])
    check(spark, W.rtrimmed_length, [((" ABCD ",), 5)])


def test_md5_family(spark):
    assert one(spark, "SELECT md5('Snowflake'), md5_binary('Snowflake')") == [
        "edf1439075a83a447fb8b630ddc9c8de", bytearray(b"\xed\xf1C\x90u\xa8:D\x7f\xb8\xb60\xdd\xc9\xc8\xde")]
    lo, hi = one(spark, "SELECT md5_number_lower64('Snowflake'), md5_number_upper64('Snowflake')")
    assert int(lo) == 9203306159527282910 and int(hi) == 17145559544104499780


def test_initcap(spark):
    # Fixed values.
    check(spark, W.initcap, [(("The Quick Gray Fox",), "The Quick Gray Fox"), (("the sky is blue",), "The Sky Is Blue"),
                             (("OVER the River 2 times",), "Over The River 2 Times")])


def test_strtok(spark):
    # Text, delimiters, number of the token, and the token.
    address = "user@snowflakezcom"
    check(spark, W.strtok, [((address, "@z", 1), "user"), ((address, "@z", 2), "snowflake"), ((address, "@z", 3), "com"),
                            ((address, "@z", 4), None), (("a b", " ", 1), "a")])


def test_strtok_takes_any_delimiter_literally(spark):
    check(spark, W.strtok, [
        (("a.b-c", ".-", 3), "c"), (("a]b", "]", 2), "b"), (("a&&b&c", "&&", 3), "c"), (("a^b", "^", 2), "b"), (("a\\b", "\\", 2), "b"),
        (("adb\\Ec", "\\E", 3), None), (("a\\Ec", "\\E", 2), "c"), (("a[b", "[", 2), "b"), (("adb", "d", 2), "b"), (("a-z", "a-z", 1), None)])


def test_regexp_substr_all(spark):
    s = "'a1_a2a3_a4A5a6'"
    assert one(spark, f"SELECT regexp_substr_all({s}, 'a[[:digit:]]')") == [["a1", "a2", "a3", "a4", "a6"]]
    assert one(spark, f"SELECT regexp_substr_all({s}, 'a[[:digit:]]', 2)") == [["a2", "a3", "a4", "a6"]]
    assert one(spark, f"SELECT regexp_substr_all({s}, 'a[[:digit:]]', 1, 3)") == [["a3", "a4", "a6"]]
    assert one(spark, f"SELECT regexp_substr_all({s}, 'a[[:digit:]]', 2, 3)") == [["a4", "a6"]]


def test_regexp_instr(spark):
    s = "'nevermore1, nevermore2, nevermore3'"
    got = one(spark, f"SELECT wh_regexp_instr({s}, 'nevermore\\\\d'), wh_regexp_instr({s}, 'nevermore\\\\d', 5), "
                     f"wh_regexp_instr({s}, 'nevermore\\\\d', 1, 3), wh_regexp_instr({s}, 'nevermore\\\\d', 1, 4)")
    assert got == [1, 13, 25, 0]


def test_regexp_like_replace_substr(spark):
    assert one(spark, "SELECT wh_regexp_like('San Francisco', 'San.*'), "
                      "wh_regexp_like('Los Angeles', 'San.*'), wh_regexp_like('xSan', 'San')") == [True, False, False]
    assert one(spark, "SELECT wh_regexp_replace('It was the best of times, it was the worst of times', "
                      "'( ){1,}', '')") == ["Itwasthebestoftimes,itwastheworstoftimes"]
    assert one(spark, "SELECT wh_regexp_substr('s3://b/cell=ab12/f.json', 'cell=([[:alnum:]]+)/', 1, 1, 1), "
                      "wh_regexp_substr('s3://b/f.json', 'cell=([[:alnum:]]+)/', 1, 1, 1)") == ["ab12", None]


def test_typeof_variant(spark):
    rows = spark.sql("""
        SELECT column1 AS n, parse_json(column2) AS v FROM VALUES
          (1, 'null'), (2, NULL), (3, 'true'), (4, '-17'), (5, '123.12'), (6, '1.912e2'),
          (7, '"Om ara pa ca na dhih"  '), (8, '[-1, 12, 289, 2188, false]'),
          (9, '{ "x" : "abc", "y" : false, "z": 10} ') AS vals(column1, column2)
    """).select("n", F.to_json("v").alias("j"), W.typeof_variant("v").alias("t")).orderBy("n").collect()
    assert [r.t for r in rows] == ["NULL_VALUE", None, "BOOLEAN", "INTEGER", "DECIMAL", "DECIMAL",
                                   "VARCHAR", "ARRAY", "OBJECT"]
    assert [r.j for r in rows] == ["null", None, "true", "-17", "123.12", "191.2", '"Om ara pa ca na dhih"',
                                   "[-1,12,289,2188,false]", '{"x":"abc","y":false,"z":10}']


def test_typeof_scalar(spark):
    df = spark.sql("SELECT 1 AS a, 1.1 AS b, 'foo' AS c, 1.1e2 AS d")
    assert list(df.select(*[W.typeof_scalar(c) for c in "abcd"]).first()) == [
        "INTEGER", "DECIMAL", "VARCHAR", "DOUBLE"]


def test_object_path_and_canonical_json(spark):
    df = spark.sql("""SELECT 1 AS id, parse_json('{"first_name": "John", "last_name": "Corner",
        "createddate": "2019-07-02T10:01:30+00:00", "type": "Owner",
        "country": {"code": "US", "name": "United States"}}') AS obj""")
    r = df.select(W.canonical_json("obj"), W.canonical_json(W.json_path("obj", "$.country"))).first()
    assert r[0] == ('{"country":{"code":"US","name":"United States"},"createddate":"2019-07-02T10:01:30+00:00",'
                    '"first_name":"John","last_name":"Corner","type":"Owner"}')
    assert r[1] == '{"code":"US","name":"United States"}'
    assert one(spark, "SELECT is_object(parse_json('{}')), is_object(parse_json('[1]')), "
                      "is_array(parse_json('[1]')), to_json(as_object(parse_json('[1]')))") == [
        True, False, True, None]


def test_array_construct(spark):
    assert spark.range(1).select(F.to_json(W.array_construct(F.lit(1), F.lit(2), F.lit(3)))).first()[0] == "[1,2,3]"


def test_to_timestamp_text(spark):
    got = one(spark, "SELECT wh_to_timestamp('2024-01-01 00:00:07.179575'), wh_to_timestamp('1704067207179'), "
                     "wh_to_timestamp('1704067207'), wh_to_timestamp('1704067207179575'), "
                     "wh_to_timestamp('2019-07-02T10:01:30+00:00'), wh_to_timestamp(NULL), wh_to_timestamp('junk')")
    assert got == [dt.datetime(2024, 1, 1, 0, 0, 7, 179575), dt.datetime(2024, 1, 1, 0, 0, 7, 179000),
                   dt.datetime(2024, 1, 1, 0, 0, 7), dt.datetime(2024, 1, 1, 0, 0, 7, 179575),
                   dt.datetime(2019, 7, 2, 10, 1, 30), None, None]


def test_datediff_minutes_counts_boundaries(spark):
    got = one(spark, "SELECT datediff_minutes(TIMESTAMP_NTZ'2024-01-01 00:00:59', TIMESTAMP_NTZ'2024-01-01 00:01:00'), "
                     "datediff_minutes(TIMESTAMP_NTZ'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:00:59'), "
                     "datediff_minutes(TIMESTAMP_NTZ'2024-01-01 10:00:00', TIMESTAMP_NTZ'2024-01-01 08:30:30')")
    assert got == [1, 0, -90]


def test_session_zone_does_not_matter(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = one(spark, "SELECT wh_to_timestamp('1704067207179'), "
                         "datediff_minutes(TIMESTAMP_NTZ'2024-03-10 01:59:00', TIMESTAMP_NTZ'2024-03-10 03:01:00')")
        assert got == [dt.datetime(2024, 1, 1, 0, 0, 7, 179000), 62]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dialect_functions_stay_in_codegen(spark):
    df = spark.sql("SELECT div0(id, id - 1) AS r, charindex('1', CAST(id AS STRING)) AS c FROM range(10)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    assert "CASE WHEN" in plan


def test_capped_distance_property(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=25, deadline=None)
    @given(st.text(alphabet="abcde ", max_size=12), st.text(alphabet="abcde ", max_size=12),
           st.integers(min_value=0, max_value=6))
    def check(a, b, cap):
        df = spark.createDataFrame([(a, b, cap)], "a string, b string, cap int")
        full, capped = df.select(W.editdistance("a", "b"), W.editdistance("a", "b", "cap")).first()
        assert capped == min(full, cap)

    check()


def test_convert_timezone_to_utc_wall_clock(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS la, TIMESTAMP_NTZ'2024-07-01 00:00:00' AS la_summer")
    r = df.select(W.to_utc_ntz("la", F.lit("America/Los_Angeles")),
                  W.to_utc_ntz("la_summer", F.lit("America/Los_Angeles"))).first()
    assert list(r) == [dt.datetime(2024, 1, 1, 8, 0), dt.datetime(2024, 7, 1, 7, 0)]
    now_utc = spark.range(1).select(W.utc_now()).first()[0]
    assert abs((now_utc - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 120


def test_regexp_like_is_anchored_at_the_very_end(spark):
    check(spark, W.regexp_like, [(("San", "San"), True), (("San\n", "San"), False), (("San Jose", "San"), False), (("San Jose", "San.*"), True)])


def test_epoch_digits_of_any_size(spark):
    check(spark, W.to_timestamp, [
        (("0",), dt.datetime(1970, 1, 1)), (("-86400",), dt.datetime(1969, 12, 31)),
        (("1705276800000",), dt.datetime(2024, 1, 15)), (("not a time",), None), (("9" * 30,), None)])
    smallest = spark.range(1).select(W.to_timestamp(F.lit("-9223372036854775808"))).first()[0]
    assert smallest.year == 1677


def test_functions_follow_the_session(spark):
    other = spark.newSession()
    from tidelake.functions.dialect import register
    register(other)
    assert other.sql("SELECT wh_chr(65)").first()[0] == "A"
    register(other)
