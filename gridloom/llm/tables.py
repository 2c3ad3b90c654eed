"""Shared plumbing: checkpoint folder, partition counts, reading input tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.shipping import ship

#: Rows of a few numbers each for which a checkpoint takes a file of its own, and the files that it takes at least.
ROWS_PER_FILE, LEAST_FILES = 20_000, 8


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Readies the session for the operators here: ships the package and sets the checkpoint folder.

    That is the folder named in spark.checkpoint.dir. Where it is unset, a local session,
    as in tests, takes a temporary one; on a cluster, where executors could not read
    that, it is an error.
    """
    ship(spark)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions_for(spark: SparkSession) -> int:
    """Partitions for sorts and deals: what the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settled(df: DataFrame, rows: int) -> DataFrame:
    """A checkpoint of narrow rows, about so many of them: in fewer files than partitions where they are few."""
    return df.coalesce(max(1, min(partitions_for(df.sparkSession), LEAST_FILES + rows // ROWS_PER_FILE))).checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that checkpoints have overtaken: it does so once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
