"""Warehouse-dialect functions defined once, as Spark SQL functions.

Each entry is the body of a ``CREATE TEMPORARY FUNCTION .. RETURN <expr>``.
Spark inlines SQL functions during analysis, so a call becomes ordinary
built-in expressions inside whole-stage codegen: no Python runs per row, and
the same definition serves ``spark.sql`` text, the DataFrame wrappers in
``tidelake.functions`` and streaming queries.

Names that Spark already owns with different semantics (``chr``,
``typeof``, ``regexp_*``, ``insert``) are registered with a ``wh_`` prefix.
Functions whose Spark built-in already behaves like the dialect (``ascii``,
``left``, ``right``, ``repeat``, ``space``, ``position``, ``contains``,
``endswith``, ``bit_length``, ``octet_length``, ``md5``, ``exp``, ``ln``,
``initcap``, ``parse_json``, ``array``) are not redefined.
"""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

# POSIX bracket classes and the Java regex classes they mean.
POSIX_CLASSES = [
    ("[:alnum:]", r"\p{Alnum}"),
    ("[:alpha:]", r"\p{Alpha}"),
    ("[:blank:]", r"\p{Blank}"),
    ("[:cntrl:]", r"\p{Cntrl}"),
    ("[:digit:]", r"\p{Digit}"),
    ("[:graph:]", r"\p{Graph}"),
    ("[:lower:]", r"\p{Lower}"),
    ("[:print:]", r"\p{Print}"),
    ("[:punct:]", r"\p{Punct}"),
    ("[:space:]", r"\p{Space}"),
    ("[:upper:]", r"\p{Upper}"),
    ("[:xdigit:]", r"\p{XDigit}"),
]

# Epoch magnitudes that tell seconds, milliseconds, microseconds and
# nanoseconds apart in digit-only time text (one year in each unit).
EPOCH_SECONDS_LIMIT = 31536000000
EPOCH_MILLIS_LIMIT = 31536000000000
EPOCH_MICROS_LIMIT = 31536000000000000


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _posix_body() -> str:
    expr = "p"
    for cls, java in POSIX_CLASSES:
        expr = f"replace({expr}, {_sql_str(cls)}, {_sql_str(java)})"
    return expr


def _replacement_body() -> str:
    even = r"(?<!\\)((?:\\\\)*)"  # an even number of backslashes, not behind another one
    expr = "r"
    for pattern, put in ((even + r"\$", r"$1\\\$"), (even + r"\\([0-9])", r"$1\$$2"), (even + r"\\(?![\\$])", r"$1\\\\")):
        expr = f"regexp_replace({expr}, {_sql_str(pattern)}, {_sql_str(put)})"
    return expr


# Stand-ins while JSON text is taken apart. Compact JSON text holds no control characters, since strings escape them.
_JSON_ESCAPES = (("\\\\", "\x01"), ('\\"', "\x02"))
_JSON_MARKS, _JSON_HIDDEN = "{}[],:", "\x03\x04\x05\x06\x07\x08"
_JSON_BLOCK = 256


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _indented_body() -> str:
    """Lines first, then their depths. Escapes are replaced, so that every quote left starts or ends a string;
    marks inside strings are hidden, so that every mark left is structure, and the text is cut into lines by
    replacements over the whole of it. Lines are taken in blocks; what a block does to the depth is summed
    first, so that no more than a block's text is ever appended to."""
    replaced, restored = "to_json(v)", f"translate(out, {_sql_str(_JSON_HIDDEN)}, {_sql_str(_JSON_MARKS)})"
    for escape, mark in _JSON_ESCAPES:
        replaced, restored = f"replace({replaced}, {_sql_str(escape)}, {_sql_str(mark)})", f"replace({restored}, {_sql_str(mark)}, {_sql_str(escape)})"
    hidden = (f"array_join(transform(split({replaced}, '\"'), (p, i) -> "
              f"IF(i % 2 = 1, translate(p, {_sql_str(_JSON_MARKS)}, {_sql_str(_JSON_HIDDEN)}), p)), '\"')")
    cut = f"replace(replace({hidden}, ':', ': '), ',', ',\n')"
    for pattern, put in ((r"([{\[])(?![}\]])", "$1\n"), (r"(?<![{\[])([}\]])", "\n$1")):
        cut = f"regexp_replace({cut}, {_sql_str(pattern)}, {_sql_str(put)})"
    opens = "IF(endswith(t, '{') OR endswith(t, '['), 1, 0)"
    closes = "IF(startswith(t, '}') OR startswith(t, ']'), 1, 0)"

    def render(some: str, depth: str) -> str:
        return (f"aggregate({some}, named_struct('d', {depth}, 'text', ''), (s, t) -> named_struct('d', s.d + {opens} - {closes}, "
                f"'text', concat(s.text, '\n', repeat('  ', s.d - {closes}), t)), s -> s.text)")

    blocks = f"transform(sequence(0, (size(lines) - 1) div {_JSON_BLOCK}), n -> slice(lines, n * {_JSON_BLOCK} + 1, {_JSON_BLOCK}))"
    steps = f"transform(blocks, b -> aggregate(b, 0, (s, t) -> s + {opens} - {closes}))"
    depth = "aggregate(slice(steps, 1, k), 0, (s, x) -> s + x)"
    many = _let("blocks", blocks, _let("steps", steps, f"array_join(transform(blocks, (b, k) -> {render('b', depth)}), '')"))
    text = f"CASE WHEN size(lines) <= {_JSON_BLOCK} THEN {render('lines', '0')} ELSE {many} END"
    whole = _let("lines", f"split({cut}, '\n')", _let("out", f"substr({text}, 2)", restored))
    return f"CASE WHEN v IS NULL THEN NULL ELSE {whole} END"


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# name -> (parameters, return type, body)
DEFINITIONS: dict[str, tuple[str, str, str]] = {
    # ---- regular expressions -------------------------------------------
    "wh_posix": ("p STRING", "STRING", _posix_body()),
    # The pattern behind a start position: the characters before it are a first match of their own, so
    # that the search goes on behind them and still sees them (look-behind, ``^``, ``\\b``).
    "wh_from": ("p STRING, position INT", "STRING",
                "CASE WHEN position <= 1 THEN wh_posix(p) ELSE "
                f"concat({_sql_str('(?s:\\A.{')}, CAST(position - 1 AS STRING), {_sql_str('})|(?:')}, wh_posix(p), ')') END"),
    "wh_matches": (
        "s STRING, p STRING, position INT, grp INT", "ARRAY<STRING>",
        "CASE WHEN position <= 1 THEN regexp_extract_all(s, wh_posix(p), grp) "
        "WHEN position > length(s) + 1 THEN slice(array(s), 1, 0) "
        "ELSE slice(regexp_extract_all(s, wh_from(p, position), grp), 2, length(s) + 2) END"),
    "regexp_substr_all": (
        "s STRING, p STRING, position INT DEFAULT 1, occurrence INT DEFAULT 1",
        "ARRAY<STRING>",
        "filter(wh_matches(s, p, position, 0), (m, i) -> i >= occurrence - 1)",
    ),
    "wh_regexp_substr": (
        "s STRING, p STRING, position INT DEFAULT 1, occurrence INT DEFAULT 1, grp INT DEFAULT 0",
        "STRING",
        "get(wh_matches(s, p, position, grp), occurrence - 1)",
    ),
    "wh_regexp_count": (
        "s STRING, p STRING, position INT DEFAULT 1",
        "INT",
        "size(wh_matches(s, p, position, 0))",
    ),
    # A character that the text does not hold (of the 32 noncharacters U+FDD0 .. U+FDEF).
    "wh_mark": ("s STRING", "STRING",
                f"get(filter(split('{''.join(map(chr, range(0xFDD0, 0xFDF0)))}', ''), c -> NOT contains(s, c)), 0)"),
    # Start of the n-th match: a mark is set before every match, in one walk over the text; the pieces
    # before the n-th mark are what precedes it. An empty match is one, and the next is sought a character on
    # (half a character on, where that lies beyond U+FFFF, as Java's walk does).
    "wh_regexp_instr": (
        "s STRING, p STRING, position INT DEFAULT 1, occurrence INT DEFAULT 1",
        "INT",
        "CASE WHEN s IS NULL OR p IS NULL THEN NULL "
        "WHEN position <= 1 AND occurrence = 1 AND NOT s RLIKE wh_posix(p) THEN 0 "
        "WHEN position > length(s) + 1 THEN 0 "
        "ELSE get(transform(array(named_struct('m', wh_mark(s), 'p', wh_from(p, position))), w -> get(transform(array("
        "split(regexp_replace(s, w.p, concat(w.m, '$0')), w.m)), pieces -> "
        "CASE WHEN size(pieces) - 1 - IF(position > 1, 1, 0) < occurrence THEN 0 "
        "ELSE 1 + aggregate(slice(pieces, 1, occurrence + IF(position > 1, 1, 0)), 0, (acc, x) -> acc + length(x)) END"
        "), 0)), 0) END",
    ),
    # The dialect anchors the pattern at both ends.
    "wh_regexp_like": (
        "s STRING, p STRING",
        "BOOLEAN",
        "s RLIKE concat('^(?:', wh_posix(p), ')\\\\z')",
    ),
    "wh_regexp_replace": (
        "s STRING, p STRING, r STRING DEFAULT ''",
        "STRING",
        "regexp_replace(s, wh_posix(p), wh_replacement(r))",
    ),
    # The dialect's replacement text as Java's: ``\\1`` names a group, ``$`` and a lone backslash are themselves.
    "wh_replacement": ("r STRING", "STRING", _replacement_body()),
    # ---- text ------------------------------------------------------------
    "charindex": (
        "needle STRING, s STRING, start INT DEFAULT 1",
        "INT",
        "locate(needle, s, start)",
    ),
    "editdistance": (
        "a STRING, b STRING, max_distance INT DEFAULT NULL",
        "INT",
        "CASE WHEN max_distance IS NULL THEN levenshtein(a, b) "
        "WHEN levenshtein(a, b, max_distance) < 0 THEN max_distance "
        "ELSE levenshtein(a, b, max_distance) END",
    ),
    # Code point -> character through UTF-32 (Spark's chr wraps at 256).
    "wh_chr": ("n BIGINT", "STRING", "decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32')"),
    "wh_insert": (
        "s STRING, pos INT, len INT, ins STRING",
        "STRING",
        "overlay(s PLACING ins FROM pos FOR len)",
    ),
    "rtrimmed_length": ("s STRING", "INT", "length(rtrim(s))"),
    # Delimiters are a set of single characters; empty tokens are skipped.
    "strtok": (
        "s STRING, delims STRING DEFAULT ' ', n INT DEFAULT 1",
        "STRING",
        "CASE WHEN delims = '' THEN CASE WHEN n = 1 AND s <> '' THEN s END "
        "ELSE get(filter(split(s, concat('[\\\\Q', replace(delims, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E]')),"
        " t -> t <> ''), n - 1) END",
    ),
    # ---- binary, codecs, hashes -------------------------------------------
    "base64_encode": ("b BINARY", "STRING", "replace(base64(b), '\\r\\n', '')"),
    "base64_decode_string": ("s STRING", "STRING", "CAST(unbase64(s) AS STRING)"),
    "base64_decode_binary": ("s STRING", "BINARY", "unbase64(s)"),
    "hex_encode": ("b BINARY", "STRING", "hex(b)"),
    "hex_decode_binary": ("s STRING", "BINARY", "unhex(s)"),
    "hex_decode_string": ("s STRING", "STRING", "CAST(unhex(s) AS STRING)"),
    "md5_binary": ("b BINARY", "BINARY", "unhex(md5(b))"),
    "md5_number_lower64": (
        "b BINARY", "DECIMAL(20,0)", "CAST(conv(right(md5(b), 16), 16, 10) AS DECIMAL(20,0))"),
    "md5_number_upper64": (
        "b BINARY", "DECIMAL(20,0)", "CAST(conv(left(md5(b), 16), 16, 10) AS DECIMAL(20,0))"),
    # ---- numbers -----------------------------------------------------------
    # For SQL text; the DataFrame wrapper keeps the operands' own types.
    "div0": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a IS NOT NULL AND b = 0 THEN CAST(0 AS DOUBLE) ELSE a / b END"),
    "div0_number": ("a DECIMAL(38,10), b DECIMAL(38,10)", "DECIMAL(38,10)",
                    "CASE WHEN a IS NOT NULL AND b = 0 THEN CAST(0 AS DECIMAL(38,10)) ELSE CAST(a / b AS DECIMAL(38,10)) END"),
    # ---- time ----------------------------------------------------------------
    # Text time: digits are an epoch in s / ms / us / ns by magnitude, UTC;
    # anything else is parsed as a timestamp literal (zone suffix ignored).
    "wh_to_timestamp": (
        "x STRING",
        "TIMESTAMP_NTZ",
        "CASE WHEN trim(x) RLIKE '^-?[0-9]+$' THEN CASE "
        f"WHEN try_cast(trim(x) AS BIGINT) BETWEEN {1 - EPOCH_SECONDS_LIMIT} AND {EPOCH_SECONDS_LIMIT - 1} "
        f"THEN timestampadd(SECOND, try_cast(trim(x) AS BIGINT), {_EPOCH}) "
        f"WHEN try_cast(trim(x) AS BIGINT) BETWEEN {1 - EPOCH_MILLIS_LIMIT} AND {EPOCH_MILLIS_LIMIT - 1} "
        f"THEN timestampadd(MILLISECOND, try_cast(trim(x) AS BIGINT), {_EPOCH}) "
        f"WHEN try_cast(trim(x) AS BIGINT) BETWEEN {1 - EPOCH_MICROS_LIMIT} AND {EPOCH_MICROS_LIMIT - 1} "
        f"THEN timestampadd(MICROSECOND, try_cast(trim(x) AS BIGINT), {_EPOCH}) "
        f"ELSE timestampadd(MICROSECOND, try_cast(trim(x) AS BIGINT) DIV 1000, {_EPOCH}) END "
        "ELSE try_cast(x AS TIMESTAMP_NTZ) END",
    ),
    # Minute boundaries crossed between a and b (not whole elapsed minutes).
    "datediff_minutes": (
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ",
        "BIGINT",
        f"timestampdiff(MINUTE, {_EPOCH}, b) - timestampdiff(MINUTE, {_EPOCH}, a)",
    ),
    # ---- JSON / VARIANT --------------------------------------------------------
    # An object is whatever casts to an empty struct: O(1), no field copies.
    "is_object": (
        "v VARIANT", "BOOLEAN",
        "CASE WHEN v IS NULL THEN NULL ELSE try_variant_get(v, '$', 'struct<>') IS NOT NULL END"),
    "is_array": (
        "v VARIANT", "BOOLEAN",
        "CASE WHEN v IS NULL THEN NULL ELSE try_variant_get(v, '$', 'array<variant>') IS NOT NULL END"),
    "as_object": (
        "v VARIANT", "VARIANT",
        "CASE WHEN try_variant_get(v, '$', 'struct<>') IS NOT NULL THEN v END"),
    "as_array": ("v VARIANT", "ARRAY<VARIANT>", "try_variant_get(v, '$', 'array<variant>')"),
    # Two spaces a level, empty containers closed at once.
    "indented_json": ("v VARIANT", "STRING", _indented_body()),
    # A JSON double is reported as DECIMAL, like the dialect's JSON numbers; whole numbers beyond 64 bits
    # are held as decimals of 19 digits or more.
    "wh_typeof": (
        "v VARIANT",
        "STRING",
        "CASE WHEN v IS NULL THEN NULL ELSE get(transform(array(schema_of_variant(v)), t -> "
        "CASE WHEN t = 'VOID' THEN 'NULL_VALUE' "
        "WHEN t IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') OR t RLIKE '^DECIMAL.(19|[23][0-9]),0.$' THEN 'INTEGER' "
        "WHEN t LIKE 'DECIMAL%' OR t IN ('DOUBLE', 'FLOAT') THEN 'DECIMAL' "
        "WHEN t = 'STRING' THEN 'VARCHAR' "
        "WHEN t LIKE 'ARRAY%' THEN 'ARRAY' "
        "WHEN t LIKE 'OBJECT%' THEN 'OBJECT' "
        "ELSE upper(t) END), 0) END",
    ),
}

_lock = threading.Lock()


def _dependencies(name: str) -> list[str]:
    body = DEFINITIONS[name][2]
    return [d for d in DEFINITIONS if d != name and f"{d}(" in body]


def _present(spark: SparkSession, name: str) -> bool:
    """Whether the session itself has the function (sessions share nothing here)."""
    return spark._jsparkSession.sessionState().catalog().isTemporaryFunction(
        spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))


def ensure(spark: SparkSession, name: str) -> None:
    """Register one function (and the functions its body calls) if the
    session does not have it yet."""
    if _present(spark, name):
        return
    with _lock:
        _create(spark, name)


def _create(spark: SparkSession, name: str) -> None:
    for dep in _dependencies(name):
        if not _present(spark, dep):
            _create(spark, dep)
    params, ret, body = DEFINITIONS[name]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")


def register(spark: SparkSession, force: bool = False) -> None:
    """Create every dialect function as a temporary SQL function, so SQL
    text can call them.  Idempotent per session; ``force`` creates those
    again that are there."""
    with _lock:
        for name in DEFINITIONS:
            if force or not _present(spark, name):
                _create(spark, name)
