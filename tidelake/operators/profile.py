"""Profiles of nested values and of texts: types by full path (J2, J7), bottom-k hash samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import tidelake.functions as W
from tidelake.session import run_dir

CONTAINERS = ("OBJECT", "ARRAY")


def _step(path: Column, key: Column) -> Column:
    """A member's path; names that are no plain word are quoted."""
    return F.concat(path, F.lit("."), F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), key).otherwise(F.concat(F.lit('"'), key, F.lit('"'))))


def path_types(values: DataFrame, column: str) -> DataFrame:
    """(path, type_name, n) of every path of the VARIANT ``column``, to any depth: ``$`` is the value,
    ``.name`` a member, ``[*]`` any element of an array.

    One level at a time: the members and elements of a level's containers are
    exploded, written with their types (the value only where it holds more),
    counted by a partly aggregated group-by, and are the next level. NULL
    values (not JSON nulls) have no type and are left out.
    """
    spark, base = values.sparkSession, run_dir(values.sparkSession, "paths")
    level, counts = 0, []
    now = values.select(F.lit("$").alias("path"), F.col(column).alias("value")).where("value is not null")
    while True:
        kind = W.typeof_variant("value")
        held = F.when(F.col("type_name").isin(*CONTAINERS), F.col("value")).alias("value")
        now.withColumn("type_name", kind).select("path", "type_name", held).write.parquet(f"{base}/{level}")
        done = spark.read.parquet(f"{base}/{level}")
        counts.append(done.groupBy("path", "type_name").agg(F.count(F.lit(1)).alias("n")))
        more = done.where(F.col("value").isNotNull())
        if more.isEmpty():
            break
        members = (more.where(F.col("type_name") == "OBJECT")
                   .select("path", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("key", "value"))
                   .select(_step(F.col("path"), F.col("key")).alias("path"), "value"))
        elements = (more.where(F.col("type_name") == "ARRAY")
                    .select(F.concat("path", F.lit("[*]")).alias("path"), F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("value")))
        now, level = members.union(elements), level + 1
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def hash_sample(texts: DataFrame, by: str, text: str, key: str, k: int) -> DataFrame:
    """The bottom-k sketch of each group's different texts: (``by``, place, text_hash, first_key, n_copies,
    distinct_estimate).

    The hash is the lower 64 bits of the text's MD5, so the k smallest of them
    are a uniform sample of the different texts, the same however the rows are
    dealt. Copies are counted first (partly aggregated); the k smallest of a
    group are then picked in every task before they meet. The estimate is
    exact below k, else (k - 1) times 2**64 over the k-th hash.
    """
    different = (texts.where(F.col(text).isNotNull())
                 .select(F.col(by), W.md5_number_lower64(F.encode(text, "UTF-8")).alias("text_hash"), F.col(key).alias("_key"))
                 .groupBy(by, "text_hash").agg(F.min("_key").alias("first_key"), F.count(F.lit(1)).alias("n_copies")))
    smallest = different.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("text_hash"))).where(F.col("place") <= k)
    last = Window.partitionBy(by)  # k rows at most
    n, kth = F.count(F.lit(1)).over(last), F.max("text_hash").over(last).cast("double")
    estimate = F.when(n < k, n).otherwise(F.floor(F.lit(float((k - 1) * 2 ** 64)) / kth))
    return smallest.select(by, F.col("place").cast("bigint").alias("place"), "text_hash", "first_key", "n_copies",
                           estimate.cast("bigint").alias("distinct_estimate"))
