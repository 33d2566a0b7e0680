"""The folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local master leaves it unset, a temporary folder, as one machine runs everything.

    On any other master it has to be set: a guess might be a folder that each machine has for itself.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} see")
        where = f"file://{tempfile.mkdtemp(prefix='attrilake-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/attrilake/{name}-{uuid.uuid4().hex[:12]}"

    def end():
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone already
            pass

    atexit.register(end)
    return path
