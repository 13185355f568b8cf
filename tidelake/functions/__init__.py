"""Column functions with warehouse-dialect semantics.

Every function returns a ``Column`` built from Spark expressions; the
dialect ones call the SQL functions of :mod:`tidelake.functions.dialect`
(registered on first use in the active session), the rest are Spark
built-ins re-exported under the dialect's name.  Arguments are Columns or
column names; wrap literal text in ``F.lit``.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.dialect import ensure, register  # noqa: F401


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def _call(name: str, *args) -> Column:
    # The active session can be a streaming query's clone (inside
    # foreachBatch); register in the default session as well.
    sessions = {id(s): s for s in (SparkSession.getActiveSession(), SparkSession._instantiatedSession)
                if s is not None}
    for spark in sessions.values():
        ensure(spark, name)
    return F.call_function(name, *[_col(a) for a in args])


# ---- text (F1-F16, F27, F28) ---------------------------------------------
def ascii_code(s) -> Column:
    """ASCII: code point of the first character, 0 for '' (F1)."""
    return F.ascii(_col(s))


def chr_(n) -> Column:
    """CHR: character for a Unicode code point (F2)."""
    return _call("wh_chr", n)


def charindex(needle, s, start=None) -> Column:
    """CHARINDEX: 1-based position of needle, 0 when absent."""
    return _call("charindex", needle, s) if start is None else _call("charindex", needle, s, start)


def position(needle, s, start=None) -> Column:
    """POSITION(a, b[, start])."""
    return charindex(needle, s, start)


def contains(s, sub) -> Column:
    return F.contains(_col(s), _col(sub))


def endswith(s, suffix) -> Column:
    return F.endswith(_col(s), _col(suffix))


def startswith(s, prefix) -> Column:
    return F.startswith(_col(s), _col(prefix))


def editdistance(a, b, max_distance=None) -> Column:
    """EDITDISTANCE, capped at ``max_distance`` when given."""
    if max_distance is None:
        return _call("editdistance", a, b)
    return _call("editdistance", a, b, max_distance)


def insert(s, pos, length, ins) -> Column:
    """INSERT(s, pos, len, ins): replace ``len`` chars at ``pos``."""
    return _call("wh_insert", s, pos, length, ins)


def left(s, n) -> Column:
    return F.left(_col(s), _col(n))


def right(s, n) -> Column:
    return F.right(_col(s), _col(n))


def repeat(s, n) -> Column:
    return F.repeat(_col(s), _col(n))


def space(n) -> Column:
    return F.call_function("space", _col(n))


def rtrimmed_length(s) -> Column:
    return _call("rtrimmed_length", s)


def bit_length(x) -> Column:
    return F.bit_length(_col(x))


def octet_length(x) -> Column:
    return F.octet_length(_col(x))


def initcap(s) -> Column:
    return F.initcap(_col(s))


def strtok(s, delims=None, n=None) -> Column:
    """STRTOK: n-th non-empty token; delimiters are a character set."""
    args = [s] + ([delims] if delims is not None else [F.lit(" ")]) + ([n] if n is not None else [])
    return _call("strtok", *args)


# ---- binary / codecs / hashes (F17-F26) --------------------------------------
def to_binary_utf8(s) -> Column:
    return F.to_binary(_col(s), F.lit("utf-8"))


def base64_encode(b) -> Column:
    """BASE64_ENCODE without line breaks, whatever the session's chunking."""
    return _call("base64_encode", b)


def base64_decode_string(s) -> Column:
    return _call("base64_decode_string", s)


def base64_decode_binary(s) -> Column:
    return _call("base64_decode_binary", s)


def hex_encode(b) -> Column:
    return _call("hex_encode", b)


def hex_decode_binary(s) -> Column:
    return _call("hex_decode_binary", s)


def hex_decode_string(s) -> Column:
    return _call("hex_decode_string", s)


def md5(b) -> Column:
    return F.md5(_col(b))


def md5_binary(b) -> Column:
    return _call("md5_binary", b)


def md5_number_lower64(b) -> Column:
    """Low 64 bits of MD5 as an unsigned number, DECIMAL(20,0)."""
    return _call("md5_number_lower64", b)


def md5_number_upper64(b) -> Column:
    return _call("md5_number_upper64", b)


# ---- regular expressions (R1-R8) -------------------------------------------
def posix_pattern(p) -> Column:
    """Rewrite POSIX bracket classes to Java classes (folds for literals)."""
    return _call("wh_posix", p)


def regexp_substr_all(s, p, position=1, occurrence=1) -> Column:
    return _call("regexp_substr_all", s, p, position, occurrence)


def regexp_substr(s, p, position=1, occurrence=1, group=0) -> Column:
    """REGEXP_SUBSTR; NULL (not '') when nothing matches."""
    return _call("wh_regexp_substr", s, p, position, occurrence, group)


def regexp_instr(s, p, position=1, occurrence=1) -> Column:
    return _call("wh_regexp_instr", s, p, position, occurrence)


def regexp_like(s, p) -> Column:
    """Anchored match: the whole string must match."""
    return _call("wh_regexp_like", s, p)


def regexp_replace(s, p, r="") -> Column:
    """Replace every match (R7); POSIX classes allowed in the pattern."""
    return _call("wh_regexp_replace", s, p, F.lit(r) if isinstance(r, str) else r)


def regexp_count(s, p, position=1) -> Column:
    return _call("wh_regexp_count", s, p, position)


# ---- numbers (M1-M3) ----------------------------------------------------------
def div0(a, b) -> Column:
    """a / b, 0 when b = 0, NULL when either is NULL (M1); decimals stay decimals."""
    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & (b == 0), F.lit(0)).otherwise(F.try_divide(a, b))


def exp(x) -> Column:
    return F.exp(_col(x))


def ln(x) -> Column:
    return F.ln(_col(x))


# ---- time (D1-D6) ------------------------------------------------------------
def to_timestamp(x) -> Column:
    """TO_TIMESTAMP on text: ISO text or epoch digits (s/ms/us/ns) -> NTZ."""
    return _call("wh_to_timestamp", x)


def datediff_minutes(a, b) -> Column:
    """DATEDIFF('minute', a, b): minute boundaries crossed."""
    return _call("datediff_minutes", a, b)


def utc_now() -> Column:
    """CONVERT_TIMEZONE('UTC', CURRENT_TIMESTAMP())::TIMESTAMP_NTZ."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                              F.current_timestamp().cast(T.TimestampNTZType()))


def to_utc_ntz(ts, zone) -> Column:
    """Wall clock in ``zone`` (NTZ) -> UTC wall clock (NTZ)."""
    return F.convert_timezone(_col(zone), F.lit("UTC"), _col(ts))


# ---- JSON / VARIANT (J1-J8) ---------------------------------------------------
def parse_json(s) -> Column:
    return F.parse_json(_col(s))


def json_path(v, path: str, type_name: str = "variant") -> Column:
    """``v:path::type`` (P8); a missing path or a value of another type is NULL."""
    return F.try_variant_get(_col(v), path, type_name)


def is_object(v) -> Column:
    return _call("is_object", v)


def is_array(v) -> Column:
    return _call("is_array", v)


def as_object(v) -> Column:
    """``v::object``: the value when it is an object, else NULL."""
    return _call("as_object", v)


def as_array(v) -> Column:
    """``v::array`` as ARRAY<VARIANT>; NULL when not an array."""
    return _call("as_array", v)


def typeof_variant(v) -> Column:
    """TYPEOF on a VARIANT value."""
    return _call("wh_typeof", v)


def typeof_scalar(x) -> Column:
    """TYPEOF on a typed column (J3): resolved from the static type."""
    t = F.typeof(_col(x))
    return (F.when(t.isin("int", "bigint", "smallint", "tinyint"), F.lit("INTEGER"))
             .when(t.startswith(F.lit("decimal")), F.lit("DECIMAL"))
             .when(t.isin("double", "float"), F.lit("DOUBLE"))
             .when(t.isin("string") | t.startswith(F.lit("varchar")) | t.startswith(F.lit("char")),
                   F.lit("VARCHAR"))
             .when(t == "boolean", F.lit("BOOLEAN"))
             .when(t == "void", F.lit(None).cast("string"))
             .otherwise(F.upper(t)))


def canonical_json(v) -> Column:
    """Compact JSON with sorted object keys."""
    return F.to_json(_col(v))


def indented_json(v) -> Column:
    """JSON text with one member a line, two spaces a level."""
    return _call("indented_json", v)


def array_construct(*cols) -> Column:
    return F.array(*[_col(c) for c in cols])


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"annotations", "Column", "SparkSession", "F", "T"}]
