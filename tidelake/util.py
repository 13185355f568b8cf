"""File-system helpers over Hadoop's FileSystem API (works for local,
HDFS and object stores alike); only metadata operations run on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def rename_path(spark: SparkSession, src: str, dst: str) -> bool:
    fs, s = _fs(spark, src)
    jvm = spark.sparkContext._jvm
    return bool(fs.rename(s, jvm.org.apache.hadoop.fs.Path(dst)))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Immediate sub-directory names of ``path`` (partition folders)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


def read_parquet_table(spark: SparkSession, path: str, schema: str | None = None):
    """A parquet table folder as a DataFrame, or None when it holds no data
    files yet (a fresh or fully trimmed table) and no schema is given."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e):
            return None
        raise


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def list_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Data files below ``path``, relative to it; hidden files and folders are left out."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    base = fs.makeQualified(p).toString().rstrip("/") + "/"
    found, at = [], fs.listFiles(p, True)
    while at.hasNext():
        relative = at.next().getPath().toString().removeprefix(base)
        if relative.endswith(suffix) and not any(x.startswith((".", "_")) for x in relative.split("/")):
            found.append(relative)
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    data = fs.open(p)
    try:
        return bytes(data.readAllBytes()).decode("utf-8")
    finally:
        data.close()


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist; False when it does."""
    fs, p = _fs(spark, path)
    if not fs.createNewFile(p):
        return False
    write_text(spark, path, text)
    return True


def modified_at(spark: SparkSession, path: str) -> float | None:
    """A file's modification time in epoch seconds, None when it is gone."""
    fs, p = _fs(spark, path)
    try:
        return fs.getFileStatus(p).getModificationTime() / 1000
    except Exception:  # noqa: BLE001 - removed in between
        return None

