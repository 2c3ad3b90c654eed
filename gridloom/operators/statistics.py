"""Error statistics of reconstructed grids.

Values that are not numbers: extremes pass them over, but a grid whose first value is
none has none as extremes; the greatest error passes them over; the mean squared error
takes them in.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.dialect import SPARK, Dialect
from gridloom.plans.formulas import fresh


def statistic_columns(d: Dialect, ori: str, dec: str, size: int) -> dict[str, str]:
    """SQL of each statistic over two flat arrays, sums in order."""
    p = fresh("p")
    most, least, place = ("array_max", "array_min", "array_position") if d.spark else ("list_max", "list_min", "list_position")
    sizes = d.build(size, p, f"abs({d.at(ori, p)} - {d.at(dec, p)})")
    squares = d.build(size, p, f"({d.at(ori, p)} - {d.at(dec, p)}) * ({d.at(ori, p)} - {d.at(dec, p)})")
    mse = f"{d.ordered_sum(squares)} / {d.number(float(size))}"
    extreme = lambda of: f"case when isnan({d.at(ori, '0')}) then {d.at(ori, '0')} else {of}({d.numbers_only(ori)}) end"
    error = f"coalesce({most}({d.numbers_only(sizes)}), {d.number(0.0)})"
    return {
        "max_value": extreme(most),
        "min_value": extreme(least),
        "max_error": error,
        "max_error_pos": f"cast(case when {error} = 0 then 0 else {place}({sizes}, {error}) - 1 end as bigint)",
        "mse": mse,
        "psnr": f"case when {mse} = 0 then null else {d.number(20.0)} * log10(({extreme(most)} - {extreme(least)}) / sqrt({mse})) end",
    }


def statistics(df: DataFrame, dims: Sequence[int], original: str, decoded: str, compressed_bytes: str | None = None, element_bytes: int = 8) -> DataFrame:
    """grid_id with extremes, greatest error and where it first occurs, mean squared error, PSNR in dB.

    PSNR is null for an exact reconstruction. With a column of compressed sizes, the
    compression ratio too.
    """
    size = prod(dims)
    out = df.select("grid_id", *[F.expr(e).alias(k) for k, e in statistic_columns(SPARK, f"`{original}`", f"`{decoded}`", size).items()], *([compressed_bytes] if compressed_bytes else []))
    if compressed_bytes:
        out = out.withColumn("compression_ratio", F.lit(float(size * element_bytes)) / F.col(compressed_bytes)).drop(compressed_bytes)
    return out


def long_statistics(df: DataFrame, original: str = "v", decoded: str = "w") -> DataFrame:
    """The same for one or more large grids in long form (grid_id, pos, original, decoded); one partially aggregated shuffle."""
    error = F.abs(F.col(original) - F.col(decoded))
    number = lambda c: F.when(~F.isnan(c), c)
    extreme = lambda of: F.when(F.isnan(F.min_by(original, "pos")), F.lit(float("nan"))).otherwise(of(number(F.col(original))))
    agg = df.groupBy("grid_id").agg(
        extreme(F.max).alias("max_value"),
        extreme(F.min).alias("min_value"),
        F.coalesce(F.max(number(error)), F.lit(0.0)).alias("max_error"),
        F.min(F.when(~F.isnan(error), F.struct((-error).alias("e"), F.col("pos").alias("pos"))))["pos"].alias("at"),
        F.avg(error * error).alias("mse"),
    )
    agg = agg.withColumn("max_error_pos", F.when(F.col("max_error") > 0, F.col("at")).otherwise(0)).drop("at")
    return agg.withColumn("psnr", F.when(F.col("mse") > 0, 20 * F.log10((F.col("max_value") - F.col("min_value")) / F.sqrt("mse"))))


def thresholded(data: str, threshold: float) -> Column:
    """The array with values below the threshold, either sign, as 0."""
    return F.transform(data, lambda x: F.when(F.abs(x) < threshold, F.lit(0.0)).otherwise(x))


def sparse_bytes(data: str, element_bytes: int = 8) -> Column:
    """Bytes of an array stored as its values other than 0 and a bit for each place."""
    return element_bytes * F.size(F.filter(data, lambda x: x != 0)) + F.ceil(F.size(data) / 8)
