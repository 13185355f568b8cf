"""Catalog and table lifecycle.

Everything here is catalog metadata (a few rows per column or table) or a
plain SQL statement; the only data work is the per-table profile, a single
aggregate pass per table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESCRIBE_COLUMNS = ["name", "type", "kind", "null?", "default", "primary key", "unique key",
                    "check", "expression", "comment", "policy name"]


# A zoned timestamp as stored: the instant and the offset it was written with.
TIMESTAMP_TZ = "STRUCT<ts: TIMESTAMP, offset_min: INT>"


def is_timestamp_tz(dtype: T.DataType) -> bool:
    return (isinstance(dtype, T.StructType) and dtype.names == ["ts", "offset_min"]
            and isinstance(dtype["ts"].dataType, T.TimestampType))


def dialect_type(dtype: T.DataType) -> str:
    """How DESCRIBE names a Spark type in the warehouse dialect."""
    if isinstance(dtype, T.DecimalType):
        return f"NUMBER({dtype.precision},{dtype.scale})"
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "NUMBER(38,0)"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "FLOAT"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "VARCHAR"
    if isinstance(dtype, T.TimestampNTZType):
        return "TIMESTAMP_NTZ"
    if isinstance(dtype, T.TimestampType):
        return "TIMESTAMP_LTZ"
    if is_timestamp_tz(dtype):
        return "TIMESTAMP_TZ"
    if isinstance(dtype, T.BinaryType):
        return "BINARY"
    if isinstance(dtype, T.ArrayType):
        return "ARRAY"
    if isinstance(dtype, T.MapType):
        return "OBJECT"
    return dtype.simpleString().upper()


def describe(spark: SparkSession, table: str) -> DataFrame:
    """``DESC TABLE``: 11 fields per column (K11); names upper-cased."""
    rows = [(f.name.upper(), dialect_type(f.dataType), "COLUMN", "Y" if f.nullable else "N", None, "N", "N",
             None, None, (f.metadata or {}).get("comment"), None)
            for f in spark.table(table).schema.fields]
    schema = ", ".join(f"`{c}` string" for c in DESCRIBE_COLUMNS)
    return spark.createDataFrame(rows, schema)


def columns(spark: SparkSession, tables: list[tuple[str, str]]) -> DataFrame:
    """``information_schema.columns`` for (schema, table) pairs (S13), with
    ``ordinal_position`` so the order of columns is defined."""
    catalog = spark.catalog.currentCatalog().upper()
    rows = []
    for schema, table in tables:
        fields = spark.table(f"{schema}.{table}").schema.fields  # one catalog lookup per table
        for pos, f in enumerate(fields, start=1):
            rows.append((catalog, schema.upper(), table.upper(), f.name, pos, f.dataType.simpleString()))
    return spark.createDataFrame(
        rows, "table_catalog string, table_schema string, table_name string, column_name string, "
              "ordinal_position int, data_type string")


def profile(spark: SparkSession, schema: str, table: str) -> DataFrame:
    """Rows and NULLs per column of one table: one aggregate pass, then the
    single result row is unpivoted (J-free, no per-row Python)."""
    df = spark.table(f"{schema}.{table}")
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    one = df.agg(*aggs)
    stacked = one.select(
        "__rows",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("non_null"))
                            for c in df.columns])).alias("c"))
    return stacked.select(
        F.lit(schema.upper()).alias("table_schema"), F.lit(table.upper()).alias("table_name"),
        F.col("c.column_name").alias("column_name"), F.col("__rows").alias("row_count"),
        (F.col("__rows") - F.col("c.non_null")).alias("null_count"))


def create_schema(spark: SparkSession, name: str, comment: str | None = None,
                  location: str | None = None) -> str:
    """``CREATE SCHEMA IF NOT EXISTS`` (K8); ``database.schema`` flattens to
    ``database_schema``.  ``location`` keeps the schema folder in a shared
    place instead of the driver's working directory."""
    name = name.replace(".", "_").lower()
    extra = f" COMMENT '{comment}'" if comment else ""
    extra += f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{extra}")
    return name


def use(spark: SparkSession, name: str) -> None:
    """``USE`` (K9)."""
    spark.catalog.setCurrentDatabase(name.replace(".", "_").lower())


def drop_table(spark: SparkSession, name: str) -> None:
    """``DROP TABLE IF EXISTS`` (K7), idempotent."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_or_replace_table(spark: SparkSession, name: str, ddl: str, location: str | None = None,
                            comment: str | None = None) -> None:
    """``CREATE OR REPLACE TABLE`` (K6) as drop + create, which the session
    catalog accepts for parquet tables."""
    drop_table(spark, name)
    loc = f" LOCATION '{location}'" if location else ""
    com = f" COMMENT '{comment}'" if comment else ""
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet{loc}{com}")


def add_column(spark: SparkSession, table: str, column: str, type_name: str) -> None:
    """``ALTER TABLE .. ADD COLUMN`` (K10); existing rows read NULL."""
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({column} {type_name})")


def insert(df: DataFrame, table: str) -> int:
    """``INSERT INTO t SELECT ..`` (K2) returning the row count, measured
    while writing (no second pass)."""
    obs = Observation(f"insert_{table.replace('.', '_')}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.insertInto(table)
    return int(obs.get["rows"])


def insert_select(df: DataFrame, table: str, columns_: list[str]) -> int:
    """``INSERT INTO t (cols) SELECT ..`` (K3): df's columns in the order of
    ``columns_``; the table's other columns get NULL."""
    target = df.sparkSession.table(table).schema
    unknown = set(columns_) - set(target.names)
    if unknown or len(columns_) != len(df.columns):
        raise ValueError(f"cannot insert {df.columns} into {columns_} of {table}")
    named = df.toDF(*columns_)
    return insert(named.select(*[(F.col(f.name) if f.name in columns_ else F.lit(None)).cast(f.dataType).alias(f.name)
                                 for f in target.fields]), table)


def insert_values(spark: SparkSession, table: str, rows: list[tuple], columns_: list[str]) -> int:
    """``INSERT INTO t (cols) VALUES ..`` (K1, K3): each literal takes its
    target column's type as SQL would cast it; unnamed columns get NULL."""
    target = spark.table(table).schema
    fields = [T.StructField(c, _literal_type(target[c].dataType), True) for c in columns_]
    values = [tuple(_literal(v, f.dataType) for v, f in zip(r, fields, strict=True)) for r in rows]
    return insert_select(spark.createDataFrame(values, T.StructType(fields)), table, columns_)


def _literal_type(target: T.DataType) -> T.DataType:
    """The type literals are handed over in: numbers as exact text, so that
    neither a binary fraction nor the first row's scale decides; text as
    text; anything else as the column's own type."""
    if isinstance(target, (T.NumericType, T.StringType, T.VarcharType, T.CharType)):
        return T.StringType()
    return target


def _literal(value, dtype: T.DataType):
    if value is None or not isinstance(dtype, T.StringType):
        return value
    return str(value)


def show_tables(spark: SparkSession, schema: str) -> DataFrame:
    """``SHOW TABLES``."""
    return spark.sql(f"SHOW TABLES IN {schema}")


def show_schemas(spark: SparkSession) -> DataFrame:
    """``SHOW DATABASES``."""
    return spark.sql("SHOW SCHEMAS")


def current_schema(spark: SparkSession) -> str:
    """``CURRENT_SCHEMA()`` (K9)."""
    return spark.sql("SELECT current_schema()").first()[0]


def table_properties(spark: SparkSession, table: str) -> dict[str, str]:
    """A table's properties and, under ``comment``, its comment."""
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect():
        if r["col_name"] == "Comment":
            found["comment"] = r["data_type"]
    return found
