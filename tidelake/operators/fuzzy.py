"""Edit-distance match as a similarity join.

All pairs of different texts within ``limit`` edits, without comparing all
pairs and without losing one:

* Texts of up to SHORT + limit characters by deletion neighbourhoods. If two
  texts are within ``limit`` edits, some text can be made from both by leaving
  out at most ``limit`` characters of each. So each text is listed under the
  hashes of its variants with up to ``limit`` characters left out, and texts
  that share one meet in an equi-join.
* Longer ones, whose variants would be too many, by segments. Of ``limit`` + 1
  segments of one text, ``limit`` edits leave one untouched, which stands in
  the other text at most ``limit`` characters away from its place. So each text
  is listed under its segments, and asks under its own substrings at those
  places for each length of the other text that ``limit`` allows.

A pair with one text on each side of SHORT differs in length by at most
``limit``, so both are listed under variants. What meets is a candidate; the
exact capped distance decides last.

Texts are compared once however many rows share them: a text is a class, known
by the smallest key of its rows, with their count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import run_dir

#: Characters up to which a text is listed under its variants (about n**limit / limit! of them).
SHORT = 32


def left_out(text: Column, limit: int) -> Column:
    """All variants of a text with up to ``limit`` characters left out, each once."""
    def shorter(t: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: F.concat(F.substring(t, F.lit(1), k - 1), F.substring(t, k + 1, F.length(t))))
        return F.when(F.length(t) > 0, cut).otherwise(F.array().cast("array<string>"))

    found = last = F.array(text)
    for _ in range(limit):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def _by_variants(texts: DataFrame, limit: int) -> DataFrame:
    listed = (texts.where(F.length("text") <= SHORT + limit)
              .select("id", F.explode(left_out(F.col("text"), limit)).alias("variant")).select("id", F.xxhash64("variant").alias("variant")))
    other = listed.select(F.col("id").alias("b"), "variant")
    return listed.withColumnRenamed("id", "a").join(other, "variant").where("a < b").select("a", "b")


def _segment(length: Column, k: int, limit: int) -> tuple[Column, Column]:
    """Start (from 0) and size of the k-th of ``limit`` + 1 near-equal segments."""
    start, end = (F.floor(length * n / F.lit(limit + 1)).cast("int") for n in (k, k + 1))
    return start, end - start


def _by_segments(texts: DataFrame, limit: int) -> DataFrame:
    """Pairs of long texts, the longer one asking (of two equally long ones both ask)."""
    long = texts.where(F.length("text") > SHORT).withColumn("n", F.length("text"))
    listed, asked = [], []
    for k in range(limit + 1):
        start, size = _segment(F.col("n"), k, limit)
        listed.append(F.xxhash64("n", F.lit(k), F.substring(F.col("text"), start + 1, size)))
        for less in range(limit + 1):
            start, size = _segment(F.col("n") - less, k, limit)
            asked += [F.when((start + move >= 0) & (start + move + size <= F.col("n")),
                             F.xxhash64(F.col("n") - less, F.lit(k), F.substring(F.col("text"), start + move + 1, size)))
                      for move in range(-limit, limit + 1)]
    listed = long.select(F.col("id").alias("r"), F.explode(F.array(*listed)).alias("segment"))
    asked = long.select(F.col("id").alias("s"), F.explode(F.array_distinct(F.filter(F.array(*asked), lambda h: h.isNotNull()))).alias("segment"))
    return listed.join(asked, "segment").where("r <> s").select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b"))


def similar_pairs(texts: DataFrame, limit: int) -> DataFrame:
    """(a, b, distance), a < b: all pairs of ids of ``texts`` (id, text; different ids, different
    texts, none null) that are at most ``limit`` edits apart."""
    candidates = _by_variants(texts, limit).union(_by_segments(texts, limit)).distinct()
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    distance = F.levenshtein("text_a", "text_b", limit)
    return (candidates.join(left, "a").join(right, "b").select("a", "b", distance.cast("bigint").alias("distance")).where("distance >= 0"))


def text_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, n_rows) of each different text: the smallest key of its rows and their number.
    Written once to the shared folder, since the match reads them several times."""
    spark = df.sparkSession
    classes = (df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text"))
               .agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("n_rows")))
    path = run_dir(spark, "text-classes")
    classes.write.parquet(path)
    return spark.read.schema(classes.schema).parquet(path)


def neighbours(df: DataFrame, key: str, text: str, limit: int = 2) -> DataFrame:
    """For each row of ``df`` its text's class and that class's links.

    Columns: ``key``, class_key (smallest key with that text), n_same (rows
    with that text), n_links (other texts within ``limit`` edits),
    nearest_key (class_key of the nearest of them, ties to the smaller key)
    and nearest_distance. Rows without a text or without a key in their whole
    class have no links; an empty text is a text.
    """
    classes = text_classes(df, key, text)
    pairs = similar_pairs(classes.where(F.col("id").isNotNull()).select("id", "text"), limit)
    ends = pairs.select(F.col("a").alias("of"), F.col("b").alias("other"), "distance").union(pairs.select("b", "a", "distance"))
    links = ends.groupBy("of").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct("distance", "other")).alias("nearest"))
    known = classes.join(links, F.col("id") == F.col("of"), "left").withColumnRenamed("text", "of_text")
    return (df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(known, F.col("_text") == F.col("of_text"), "left")
            .select(F.col("_key").alias(key), F.col("id").alias("class_key"), F.coalesce("n_rows", F.lit(0)).alias("n_same"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("nearest.other").alias("nearest_key"),
                    F.col("nearest.distance").alias("nearest_distance")))
