"""Registered queries of the edit-distance match (F7, F8), with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import fuzzy
from tidelake.sources.tables import read_table

LIMIT = 2


def fuzzy_part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different part names within two edits, as smallest part keys."""
    classes = fuzzy.text_classes(read_table(spark, sf_dir, "part"), "p_partkey", "p_name").select("id", "text")
    return fuzzy.similar_pairs(classes, LIMIT).select(F.col("a").alias("left_key"), F.col("b").alias("right_key"), "distance")


def fuzzy_part_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the class of its name, the other names within two edits and the nearest of them."""
    return fuzzy.neighbours(read_table(spark, sf_dir, "part"), "p_partkey", "p_name", LIMIT)


def fuzzy_host_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the hosts within two edits of its own (look-alike hosts)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    return fuzzy.neighbours(pages, "page_id", "host", LIMIT)


QUERIES = {f.__name__: f for f in (fuzzy_part_links, fuzzy_part_neighbours, fuzzy_host_neighbours)}

_CLASSES = "classes AS (SELECT {text} AS t, min({key}) AS id, count(*) AS n FROM {table} WHERE {text} IS NOT NULL GROUP BY 1)"
_NEIGHBOURS = """
WITH """ + _CLASSES + """,
links AS (SELECT a.id AS l, count(*) AS n, min(levenshtein(a.t, b.t)) AS d, first(b.id ORDER BY levenshtein(a.t, b.t), b.id) AS o
          FROM classes a JOIN classes b ON a.id <> b.id AND levenshtein(a.t, b.t) <= 2 GROUP BY a.id)
SELECT r.{key}, c.id AS class_key, coalesce(c.n, 0) AS n_same, coalesce(links.n, 0) AS n_links, o AS nearest_key, d AS nearest_distance
FROM {table} r LEFT JOIN classes c ON r.{text} = c.t LEFT JOIN links ON links.l = c.id
"""
_PART = {"text": "p_name", "key": "p_partkey", "table": "part"}
_HOST = {"text": "host", "key": "page_id",
         "table": "(SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)"}

ORACLES = {
    "fuzzy_part_links": ("WITH " + _CLASSES + """
SELECT a.id AS left_key, b.id AS right_key, levenshtein(a.t, b.t) AS distance
FROM classes a JOIN classes b ON a.id < b.id AND levenshtein(a.t, b.t) <= 2
""").format(**_PART),
    "fuzzy_part_neighbours": _NEIGHBOURS.format(**_PART),
    "fuzzy_host_neighbours": _NEIGHBOURS.format(**_HOST),
}
