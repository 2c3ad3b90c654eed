"""Grids that arrive as a stream. The transforms are stateless projections, so they run in every micro-batch as they do on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.grid import decompose, to_decomposed


def decompose_to_parquet(stream: DataFrame, dims: Sequence[int], path: str, checkpoint: str, levels: int | None = None, basis: str = "l2") -> StreamingQuery:
    """Decomposes block-form grids of a stream into a Parquet table partitioned by level; exactly once per grid."""
    out = to_decomposed(decompose(stream, dims, levels, basis), dims, levels)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("level").trigger(availableNow=True).start()
