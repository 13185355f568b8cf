"""Table access: the test tables and the connector formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet test tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SCAN_PARTITIONS = "spark.tidelake.scan.partitions"


def read_heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table for work that is CPU-heavy per row.

    A file of one row group is read by one task.  Where the user knows their
    files to be so few and large, they set ``spark.tidelake.scan.partitions``
    and rows are dealt to that many tasks first.  Unset (the default) nothing
    is shuffled, whatever the size.
    """
    df = read_table(spark, sf_dir, name)
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


#: Fewer rows than these are not worth a task of their own.
TASK_ROWS = 50_000


def read_dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table of short rows, for work that costs far more than to shuffle them.

    The rows of each split are counted first (from the files' footers). Where
    few splits hold most of them, since files have few row groups, rows are
    dealt evenly to at least as many tasks as there are cores; a table whose
    splits are even is read as it is.
    """
    df = read_heavy(spark, sf_dir, name)
    if spark.conf.get(SCAN_PARTITIONS, None):
        return df
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    rows, largest, used = splits.agg(F.sum("n"), F.max("n"), F.count("n")).first()
    tasks = min(spark.sparkContext.defaultParallelism, (rows or 0) // TASK_ROWS)
    if tasks <= 1 or largest <= 1.25 * rows / tasks:
        return df
    return df.repartition(max(tasks, used))


def register_views(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Expose test tables as temp views so SQL text can name them."""
    for name in names or TEST_TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_source(spark: SparkSession, fmt: str, path: str | None = None, **options) -> DataFrame:
    """Catalog-style scan over Spark's own readers.

    ``parquet``/``json``/``orc``/``csv`` work out of the box (local paths,
    ``s3a://`` with hadoop-aws on the classpath).  ``delta`` and ``iceberg``
    need their jars; ``jdbc`` needs a driver jar and should be given
    ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions`` so the
    read is split across executors instead of running in one task.
    """
    reader = spark.read.format(fmt)
    if fmt == "jdbc":
        missing = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} - set(options)
        if missing and "query" not in options:
            raise ValueError(f"jdbc reads must be partitioned; missing {sorted(missing)}")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path) if path is not None else reader.load()
