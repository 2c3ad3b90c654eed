"""The mass matrix's inverse along one line of any length, by its closed form.

With r = 2 - sqrt(3) and N = m - 1 the inverse has sqrt(3) / 2 * (-r)^|i - j| at (i, j),
times 1 + r^(2t) for the distance t of the nearer of i and j to each end. It decays by
0.268 a node, so terms beyond REACH are below double precision. A line is cut into
stretches; points near an edge go to both neighbours, each stretch is one sorted array,
and every value a sum of at most 2 * REACH + 1 products in a fixed order: one shuffle, no
recurrence along the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.dialect import DUCKDB, SPARK

REACH = 28
STRETCH = 4096
ROOT = 2 - 3**0.5
WEIGHTS = [3**0.5 / 2 * (-ROOT) ** k for k in range(REACH + 1)]
#: What the mirror images beyond an end at distance t add.
ENDS = [1 + ROOT ** (2 * t) for t in range(REACH + 1)]


def solve(cells: DataFrame, m: int, stretch: int = STRETCH) -> DataFrame:
    """(grid_id, i1, v) of lines of m points to the same of the solution; an error where a line has not m points or a null value."""
    if m <= 2 * REACH:
        raise ValueError(f"lines of {m} points are too short for the closed form: use mass_solve")
    value = F.when(F.col("v").isNull(), F.raise_error(F.lit("a line holds nulls")).cast("double")).otherwise(F.col("v").cast("double"))
    last = (m - 1) // stretch
    low = F.greatest(F.lit(0), F.floor((F.col("i1") - REACH) / stretch)).cast("int")
    high = F.least(F.lit(last), F.floor((F.col("i1") + REACH) / stretch)).cast("int")
    rows = cells.select("grid_id", F.col("i1").cast("long").alias("i"), value.alias("v")).withColumn("i1", F.col("i"))
    held = rows.withColumn("t", F.explode(F.sequence(low, high))).groupBy("grid_id", "t").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("xs"))
    first, end = f"greatest(0, t * {stretch} - {REACH})", f"least({m}, (t + 1) * {stretch} + {REACH})"
    whole = f"size(xs) = {end} - {first} and xs[0].i = {first} and size(array_distinct(transform(xs, x -> x.i))) = size(xs) and xs[size(xs) - 1].i = {end} - 1"
    d = SPARK
    a, b = "least(i, j)", "greatest(i, j)"
    term = f"acc + {d.numbers(WEIGHTS)}[cast({b} - {a} as int)] * {d.numbers(ENDS)}[cast(least({a}, {REACH}) as int)] * {d.numbers(ENDS)}[cast(least({m - 1} - {b}, {REACH}) as int)] * ys[cast(j - {first} as int)]"
    summed = f"aggregate(sequence(greatest(0, i - {REACH}), least({m - 1}, i + {REACH})), 0.0D, (acc, j) -> {term})"
    checked = held.withColumn("ys", F.when(F.expr(whole), F.expr("transform(xs, x -> x.v)")).otherwise(F.raise_error(F.lit("a line lacks points or holds some twice")).cast("array<double>")))
    core = f"transform(sequence(cast(t as bigint) * {stretch}, least({m}, (cast(t as bigint) + 1) * {stretch}) - 1), i -> struct(i as i1, {summed} as v))"
    return checked.select("grid_id", F.explode(F.expr(core)).alias("x")).select("grid_id", "x.i1", "x.v")


def solve_sql(source: str) -> str:
    """DuckDB SQL for the same over (i, v): every pair within REACH, summed by i in order of j."""
    d = DUCKDB
    a, b = "least(x.i, y.i)", "greatest(x.i, y.i)"
    term = f"{d.numbers(WEIGHTS)}[{b} - {a} + 1] * {d.numbers(ENDS)}[least({a}, {REACH}) + 1] * {d.numbers(ENDS)}[least(n - 1 - {b}, {REACH}) + 1] * y.v"
    return f"with e as ({source}), n as (select count(*) as n from e) select x.i::bigint as i1, {d.ordered_sum(f'list({term} order by y.i)')} as v from e x join e y on y.i between x.i - {REACH} and x.i + {REACH}, n group by x.i"
