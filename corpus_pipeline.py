"""From raw documents to packed training sequences, in four stages.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes its result
as Parquet in the shared folder, so the next stage reads a finished table and
a lost executor never reaches back over a stage. Stages 1 to 3 return the
columns of ``documents`` (any further columns pass through); the last returns
the pieces of the packed sequences. Documents with a null text have no letter
and go in stage 1. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import langid, packing, quality, simhash
from tidelake.llm.common import prepare, stash
from tidelake.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without one (``und``) go."""
    return langid.recognised(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labelled ones draws."""
    return quality.sampled(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one of the smallest id."""
    return simhash.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of near-equal, near-full windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier),
          ("simhash_near_dedup", simhash_near_dedup), ("packing", packed)]

#: Fitted models and hashes are beyond SQL: tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
