"""Connected components of a written edge list, by alternating large-star and small-star steps.

Each step needs a node's least neighbour (a partly aggregated minimum, so a
node with very many links shuffles one row from each task) and an equi-join
that hands it to the node's links (a plain join, whose hot keys adaptive
execution splits). The edge list is written to the shared folder after each
round, so that a lost executor repeats one round at most. The rounds end when
the edges no longer change; then every edge leads from a node to the least
node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import drop_stash, stash


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge other than a component's least
    node. Self-loops, repeated edges and either direction are allowed; an empty
    edge list gives an empty result."""
    now = stash(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                .where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = stash(large, "edges-large")
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(parent.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        after = stash(small, "edges")
        new = _state(after)
        drop_stash(large)
        drop_stash(now)
        now = after
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
