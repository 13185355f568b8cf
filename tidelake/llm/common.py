"""What the operators share: session settings, written intermediate tables, bounded samples.

All operators take a DataFrame, use only the columns they name, and ignore
any others (also those whose names equal an output column).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.session import run_dir, shared_dir
from tidelake.util import delete_path

#: Rows and bytes of an Arrow batch handed to Python: bounds a worker's memory with long texts.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Bounded Arrow batches, the shared checkpoint folder, and this package on the workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that a lost executor never repeats what lies before,
    and so that work which several later steps need runs once. ``drop_stash``
    removes the files of a superseded table.
    """
    spark = df.sparkSession
    path = run_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    delete_path(df.sparkSession, df.stash_path)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; null counts as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in pieces of about ``size`` characters, each but the last ending
    in a character that is no white space before one that is; nothing is lost."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and (text[end] not in " \n\t\r" or text[end - 1].isspace()):
            end += 1
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def unit_hash(*cols: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, by: str, key: str, size: int) -> DataFrame:
    """About ``size`` to ``2 * size`` rows for each value of ``by``, all rows of
    rarer values: rows whose hashed ``key`` lies below 1.5 * size / count.

    The counts cover the whole table (one partly aggregated pass over ``by``);
    the sample of a value is a hash choice, so it neither depends on the
    partitioning nor gathers a value's rows in one task. ``by`` must be a
    column of few values (languages, labels).
    """
    share = {r[0]: 1.5 * size / r[1] for r in df.groupBy(by).count().collect()}
    if not share:
        return df.limit(0)
    # A binomial draw of mean 1.5 * size stays within 2 * size but for a negligible chance.
    cut = F.coalesce(*[F.when(F.col(by).eqNullSafe(F.lit(v)), F.lit(s)) for v, s in share.items()])
    return df.where(unit_hash(key, F.lit("sample")) < cut)
