"""The change feed between two versions of a table (P7, W1), by keyed difference.

1. Prune: rows are hashed where they are read and partly aggregated into one
   checksum for each date and version; dates whose checksums agree are not
   looked at again.
2. Rows of the other dates are counted by (key, row hash), plus for the new
   version, minus for the old one. What does not cancel out has changed.
3. Within a key, old rows that went and new rows that came are paired as
   updates, in order of their hashes; the rest are deletes and inserts.
4. Only then the rows themselves are fetched, by hash: a filter of bounded
   size (``keyfilter``) drops unchanged rows where they are read, a merge join
   finds the others.

So hardly any payload of unchanged rows is shuffled, and repeated rows, also
of one key, are counted exactly. The joins are told to merge: Spark guesses a
side's size from the width of its table, far too low for a few columns of a
table of VARIANTs, and would send changes by the million through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.keyfilter import key_filter, may_match
from tidelake.session import run_dir

CHANGE_TYPE = "_change_type"
_HASH = ["_h1", "_h2"]


def _comparable(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.to_json(F.col(f"`{name}`")) if any(k in kind for k in ("variant", "struct", "map", "array")) else F.col(f"`{name}`").cast("string")


def _hashed(df: DataFrame) -> DataFrame:
    """With 128 bits that tell rows apart: an MD5 over each column's text, null told from any text."""
    parts = []
    for name in df.columns:
        text = _comparable(df, name)
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    hexed = F.md5(F.concat_ws("|", *parts).cast("binary"))
    # Never null, and known not to be: else joins test the hash for null first, and work it out twice.
    return df.withColumns({h: F.coalesce(F.conv(F.substring(hexed, at, 16), 16, -10).cast("long"), F.lit(0)) for h, at in zip(_HASH, (1, 17), strict=True)})


def changed_dates(before: DataFrame, after: DataFrame, date: str) -> list:
    """Dates whose rows differ between the versions (None for rows without a date)."""
    def sums(df: DataFrame, sign: int) -> DataFrame:
        return _hashed(df).select(F.col(date).alias("day"), F.lit(sign).alias("sign"), *[
            (F.col(h).cast("decimal(38,0)") * sign).alias(h) for h in _HASH])

    both = sums(before, -1).union(sums(after, 1))
    return [r[0] for r in both.groupBy("day").agg(F.sum("sign").alias("n"), *[F.sum(h).alias(h) for h in _HASH])
            .where("n <> 0 or _h1 <> 0 or _h2 <> 0").select("day").collect()]  # dates, not rows


def change_feed(before: DataFrame, after: DataFrame, key: list[str], date: str | None = None) -> DataFrame:
    """Rows of ``before`` and ``after`` (the same columns) that changed, with ``_change_type``:
    ``insert``, ``delete``, or ``update_preimage`` and ``update_postimage`` of a key's row.

    ``date`` names a partition column that a row never changes; without it all rows are compared.
    A null in the key is a value like any other.
    """
    columns = before.columns
    after = after.select(*[F.col(f"`{c}`") for c in columns])
    if date is not None:
        days = changed_dates(before, after, date)
        there = F.col(date).isin([d for d in days if d is not None]) | (F.lit(None in days) & F.col(date).isNull())
        before, after = before.where(there), after.where(there)
    before, after = _hashed(before), _hashed(after)
    names = [f"_k{i}" for i in range(len(key))]
    keys = [F.col(f"`{c}`").alias(n) for c, n in zip(key, names, strict=True)]
    net = (before.select(*keys, *_HASH, F.lit(-1).alias("sign")).union(after.select(*keys, *_HASH, F.lit(1).alias("sign")))
           .groupBy(*names, *_HASH).agg(F.sum("sign").alias("net")).where("net <> 0"))
    # One row for each changed copy; a key's copies are few, since the key names a row.
    copies = net.withColumn("came", F.col("net") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("net").cast("int")))).drop("net")
    side = Window.partitionBy(*names, "came")
    paired = copies.select("*", F.row_number().over(side.orderBy(*_HASH, "copy")).alias("place")).select(
        "*", (F.count(F.lit(1)).over(Window.partitionBy(*names, "place")) == 2).alias("updated"))
    staged = run_dir(before.sparkSession, "changes")
    paired.groupBy(*names, *_HASH, "came").agg(F.count_if("updated").alias("_n_updated"), F.count(F.lit(1)).alias("_n")).write.parquet(staged)
    changes = before.sparkSession.read.parquet(staged)

    def fetched(version: DataFrame, came: bool, alone: str, paired_as: str) -> DataFrame:
        due = changes.where(F.col("came") == came)
        likely = may_match(version, _HASH, key_filter(due, _HASH))
        # The hash covers the key, so that rows of one hash are of one key.
        rows = likely.join(due.select(*_HASH, "_n_updated", "_n").hint("merge"), _HASH)
        at = Window.partitionBy(*_HASH).orderBy(F.lit(0))
        rows = rows.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= F.col("_n"))
        kind = F.when(F.col("_at") <= F.col("_n_updated"), paired_as).otherwise(alone)
        return rows.select(*[F.col(f"`{c}`") for c in columns], kind.alias(CHANGE_TYPE))

    return fetched(before, False, "delete", "update_preimage").union(fetched(after, True, "insert", "update_postimage"))
