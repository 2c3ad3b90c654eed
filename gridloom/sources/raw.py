"""Raw binary grids: headerless little-endian files of float or double values."""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.levels import check_dims
from gridloom.functions.shipping import ship

KINDS = {"float": "<f4", "double": "<f8"}


def read_raw(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(path, data array<double>): one row per file; a trailing part of an element is dropped."""
    of = np.dtype(KINDS[kind])
    ship(spark)

    def run(batches):
        for batch in batches:
            values = [np.frombuffer(x, of, count=len(x) // of.itemsize).astype(np.float64) for x in (y.as_buffer() for y in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["path", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, data array<double>")


def read_grids(spark: SparkSession, path: str, dims: Sequence[int], kind: str = "double") -> DataFrame:
    """Block form of raw files in path order: (grid_id, dims, data). Sizes are checked when an operator uses them."""
    files = read_raw(spark, path, kind)
    return files.select(F.xxhash64("path").alias("grid_id"), F.array(*[F.lit(n).cast("long") for n in check_dims(dims)]).alias("dims"), "data")


def write_raw(df: DataFrame, folder: str, kind: str = "double", data: str = "data") -> DataFrame:
    """Writes grid_id.bin for each grid to a folder that all executors share; returns (grid_id, path, n_bytes).

    A file appears under its name only when complete, and a repeated task writes the
    same bytes, so lost executors do no harm. Lazy: the files are written when the
    result is.
    """
    target, of = urlparse(folder).path if "://" in folder or folder.startswith("file:") else folder, np.dtype(KINDS[kind])
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError("raw files go to a mounted folder; use df.write.parquet for other stores")
    ship(df.sparkSession)

    def run(batches):
        os.makedirs(target, exist_ok=True)
        for batch in batches:
            if batch.column(1).null_count or pa.ListArray.flatten(batch.column(1)).null_count:
                raise ValueError("a grid is null or holds nulls")
            paths, sizes = [], []
            for grid_id, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = values.values.to_numpy(zero_copy_only=False).astype(of).tobytes()
                paths.append(os.path.join(target, f"{grid_id}.bin"))
                sizes.append(len(raw))
                with open(f"{paths[-1]}.{os.getpid()}.part", "wb") as f:
                    f.write(raw)
                os.replace(f.name, paths[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["grid_id", "path", "n_bytes"])

    return df.select(F.col("grid_id").cast("long"), F.col(data).cast("array<double>")).mapInArrow(run, "grid_id long, path string, n_bytes long")


def show_rows(df: DataFrame, row_length: int, data: str = "data") -> DataFrame:
    """(grid_id, row, line): each matrix row as text, for printing."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(data) / row_length).cast("int") - 1), lambda k: F.array_join(F.slice(data, k * row_length + 1, row_length).cast("array<string>"), " "))
    return df.select("grid_id", F.posexplode(rows).alias("row", "line"))


def show_ragged(df: DataFrame, data: str = "data") -> DataFrame:
    """(grid_id, line): values as index:value."""
    return df.select("grid_id", F.array_join(F.transform(data, lambda x, k: F.concat_ws(":", k.cast("string"), x.cast("string"))), " ").alias("line"))
