"""Session plumbing: the checkpoint folder, scratch folders and shipping of the package."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession

from .shipping import ship


def ready(spark: SparkSession) -> str:
    """Ships the package and makes sure of a checkpoint folder: the one in spark.checkpoint.dir.

    Where that is unset, a local session, as in tests, takes a temporary folder; on a
    cluster executors could not read one, so that is an error.
    """
    ship(spark)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the checkpoint folder."""
    return f"{ready(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark forget the shuffles of steps that checkpoints have overtaken, on disk and in the driver: it does so once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
