"""Session defaults and the shared work folder.

Jobs never assume the session was built here: the driver may hand in its
own.  Everything that depends on a setting (time zone, base64 chunking) is
written so it does not matter; the builder below only sets sensible local
defaults for tests and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# How run_dir ends a folder's name.
_RUN = re.compile(r"-[0-9a-f]{12}$")

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bound every broadcast by size; anything larger takes a sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidelake", **extra: str) -> SparkSession:
    """Local/test session. On a cluster, pass the cluster's own settings."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or f"local[{cpus}]")
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update({k.replace("__", "."): v for k, v in extra.items()})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session.  Only a local master, whose executors share the
    driver's disk, gets a folder of its own when it is unset; on a cluster
    that is an error.
    """
    conf_dir = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
                or spark.conf.get("spark.checkpoint.dir", None))
    if conf_dir:
        return conf_dir.rstrip("/")
    jsc = spark.sparkContext._jsc  # checkpoint dir already set via setCheckpointDir
    current = jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tidelake-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def run_dir(spark: SparkSession, job: str) -> str:
    """A fresh folder for one job run under the shared folder."""
    return f"{shared_dir(spark)}/tidelake/{job}-{uuid.uuid4().hex[:12]}"


def purge_runs(spark: SparkSession, older_than_hours: float = 24.0) -> list[str]:
    """Remove the folders of job runs that nothing has written to for so
    long, and return their names.  Results of lazy jobs read their run's
    folder, so it cannot go when the job returns."""
    from tidelake.util import delete_path, list_dirs, modified_at

    root, before = f"{shared_dir(spark)}/tidelake", time.time() - older_than_hours * 3600
    gone = []
    for name in list_dirs(spark, root):
        if _RUN.search(name) and (modified_at(spark, f"{root}/{name}") or time.time()) < before:
            delete_path(spark, f"{root}/{name}")
            gone.append(name)
    return gone
