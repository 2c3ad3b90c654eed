"""The engine's queries and, for each, the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.levels import level_dims, nodal, thomas_factors
from gridloom.functions.session import scratch
from gridloom.operators import banded, grid, statistics, tiles
from gridloom.plans import formulas
from gridloom.plans.dialect import DUCKDB, DUCKDB_FLOAT, SPARK
from gridloom.sources import raw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "l2_decompose_1d_full"

#: Shapes that the leading elements of a 64-long embedding are read as.
SHAPES = {"1d": (64,), "1d_odd": (63,), "2d": (8, 8), "2d_odd": (7, 9), "2d_mixed": (7, 8), "3d": (4, 4, 4), "3d_odd": (3, 3, 5), "3d_mixed": (3, 4, 5)}
#: Their levels, written out by hand: the oracles do not rely on the engine's own count.
LEVELS = {"1d": 6, "1d_odd": 5, "2d": 3, "2d_odd": 2, "2d_mixed": 2, "3d": 2, "3d_odd": 1, "3d_mixed": 1}


def blocks(spark: SparkSession, sf_dir: str, dims: Sequence[int]) -> DataFrame:
    data = F.slice("embedding", 1, math.prod(dims)).cast("array<double>")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("grid_id"), data.alias("data"))


def block_sql(dims: Sequence[int], real: str = "double") -> str:
    return f"select vec_id as grid_id, embedding[1:{math.prod(dims)}]::{real}[] as data from embeddings"


def exploded(df: DataFrame) -> DataFrame:
    return df.select("grid_id", F.posexplode("data").alias("pos", "v")).select("grid_id", F.col("pos").cast("long").alias("pos"), "v")


def exploded_sql(dims: Sequence[int], formula: str, size: int, real: str = "double") -> str:
    return f"with g as ({block_sql(dims, real)}), r as (select grid_id, {formula} as data from g) select grid_id, unnest(range(0, {size}))::bigint as pos, unnest(data) as v from r"


def register(name: str, dims: Sequence[int], operator: Callable[[DataFrame], DataFrame], formula: str, size: int | None = None, source: str = "double") -> None:
    """A query that applies a block operator to the embedding grids, and its oracle."""
    QUERIES[name] = lambda spark, sf_dir: exploded(operator(blocks(spark, sf_dir, dims)))
    ORACLES[name] = exploded_sql(dims, formula, size or math.prod(dims), source)


def register_grid_queries() -> None:
    d = DUCKDB
    for key, dims in SHAPES.items():
        register(f"reorder_{key}", dims, lambda df, n=dims: grid.reorder(df, n), formulas.reorder(d, "data", dims))
        register(f"unreorder_{key}", dims, lambda df, n=dims: grid.unreorder(df, n), formulas.unreorder(d, "data", dims))
        register(f"residual_{key}", dims, lambda df, n=dims: grid.residual(grid.reorder(df, n), n), formulas.residual(d, formulas.reorder(d, "data", dims), dims, "-"))
        register(f"interpolate_{key}", dims, lambda df, n=dims: grid.residual(df, n, inverse=True), formulas.residual(d, "data", dims, "+"))
        register(f"l2_correction_{key}", dims, lambda df, n=dims: grid.l2_correction(df, n), formulas.correction(d, "data", dims), math.prod(map(nodal, dims)))
        most = LEVELS[key]
        for basis, short in (("hierarchical", "hier"), ("l2", "l2")):
            l2 = basis == "l2"
            for levels, suffix, taken in ((1, "l1", 1), (None, "full", most))[: 1 if most == 1 else 2]:
                register(f"{short}_decompose_{key}_{suffix}", dims, lambda df, n=dims, k=levels, b=basis: grid.decompose(df, n, k, b), formulas.decompose(d, "data", dims, taken, l2))
            register(f"recompose_{key}_{short}", dims, lambda df, n=dims, b=basis: grid.recompose(grid.decompose(df, n, None, b), n, None, b), formulas.recompose(d, formulas.decompose(d, "data", dims, most, l2), dims, most, l2))
        register(f"restriction_{key}", dims, lambda df, n=dims: grid.restriction(df, n), formulas.restriction(d, "data", dims))
    for key in ("1d", "2d", "3d"):
        dims, most = SHAPES[key], LEVELS[key]
        shapes = level_dims(dims, most)
        register(f"progressive_{key}", dims, lambda df, n=dims: grid.progressive(grid.decompose(df, n), n, 1), formulas.recompose(d, formulas.decompose(d, "data", dims, most), dims, most, upto=1), math.prod(shapes[1]))
        register_levels(key, dims, most)
        register_statistics(key, dims, most)
        register(f"float_decompose_{key}", dims, lambda df, n=dims: as_double(grid.decompose(df, n, dtype="float")), f"({formulas.decompose(DUCKDB_FLOAT, 'data', dims, most)})::double[]", source="float")
        register(f"float_roundtrip_{key}", dims, lambda df, n=dims: as_double(grid.recompose(grid.decompose(df, n, dtype="float"), n, dtype="float")), f"({formulas.recompose(DUCKDB_FLOAT, formulas.decompose(DUCKDB_FLOAT, 'data', dims, most), dims, most)})::double[]", source="float")
    register("load_vector_nodal", (64,), lambda df: grid.load_vector(zeroed(df), (64,), 0), formulas.load_axis(d, "list_concat(list_transform(range(0, 33), lambda x: 0.0::double), data[34:64])", (64,), 0), 33)
    register("load_vector_coeff", (64,), lambda df: grid.load_vector(df, (64,), 0), formulas.load_axis(d, "data", (64,), 0), 33)
    register("load_vector_vertical", (8, 8), lambda df: grid.load_vector(df, (8, 8), 0), formulas.load_axis(d, "data", (8, 8), 0), 40)
    register("mass_solve", (64,), lambda df: grid.mass_solve(df, (64,), 0), formulas.solve_axis(d, "data", (64,), 0))
    register("mass_solve_vertical", (8, 8), lambda df: grid.mass_solve(df, (8, 8), 0), formulas.solve_axis(d, "data", (8, 8), 0))
    register_boxes()


def as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("data", F.col("data").cast("array<double>"))


#: Boxes inside larger arrays: array, box, first point, levels.
BOXES = {"2d": ((8, 8), (5, 6), (0, 0), 2), "2d_inner": ((8, 8), (6, 5), (1, 2), 2), "3d": ((4, 4, 4), (3, 3, 4), (0, 0, 0), 1), "3d_inner": ((4, 4, 4), (3, 3, 3), (1, 0, 1), 1)}


def register_boxes() -> None:
    d = DUCKDB
    for key, (buffer, dims, origin, levels) in BOXES.items():
        held = formulas.box(d, "data", buffer, dims, origin)
        at = [f"({k}) + {o}" for k, o in zip([formulas.coordinate(d, "q", dims, k) for k in range(len(dims))], origin, strict=True)]
        copied = f"list_transform(range(0, {math.prod(dims)}), lambda q: data[{formulas.index(at, buffer)} + 1])"
        register(f"copy_box_{key}", buffer, lambda df, n=dims, b=buffer, o=origin: grid.copy_box(df, n, b, o), copied, math.prod(dims))
        there = lambda df, n=dims, b=buffer, o=origin: grid.decompose(df, n, buffer=b, origin=o)
        coarse = formulas.put_box(d, "data", buffer, dims, formulas.decompose(d, held, dims, levels), origin)
        register(f"decompose_box_{key}", buffer, there, coarse)
        register(f"recompose_box_{key}", buffer, lambda df, n=dims, b=buffer, o=origin: grid.recompose(df, n, buffer=b, origin=o), formulas.put_box(d, "data", buffer, dims, formulas.recompose(d, held, dims, levels), origin))


def zeroed(df: DataFrame) -> DataFrame:
    return df.withColumn("data", F.concat(F.array_repeat(F.lit(0.0), 33), F.slice("data", 34, 31)))


def register_levels(key: str, dims: Sequence[int], most: int) -> None:
    shapes = level_dims(dims, most)
    c = [formulas.coordinate(DUCKDB, "pos", dims, k) for k in range(len(dims))]
    QUERIES[f"decomposed_form_{key}"] = lambda spark, sf_dir: grid.to_decomposed(grid.decompose(blocks(spark, sf_dir, dims), dims), dims)
    axes = ", ".join(f"({c[k] if k < len(c) else '0'})::bigint as i{k + 1}" for k in range(3))
    ORACLES[f"decomposed_form_{key}"] = f"select grid_id, {axes}, v, ({formulas.level_of(DUCKDB, c, shapes)})::int as level, ({formulas.mask_of(DUCKDB, c, shapes)})::int as mask from ({exploded_sql(dims, formulas.decompose(DUCKDB, 'data', dims, most), math.prod(dims))})"


#: Coefficients below this are dropped where a grid is compressed.
THRESHOLD = 0.05


def register_statistics(key: str, dims: Sequence[int], most: int) -> None:
    size = math.prod(dims)

    def there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = blocks(spark, sf_dir, dims).withColumn("ori", F.col("data"))
        return grid.recompose(grid.decompose(both, dims), dims)

    def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = grid.decompose(blocks(spark, sf_dir, dims).withColumn("ori", F.col("data")), dims)
        kept = both.withColumn("data", statistics.thresholded("data", THRESHOLD)).withColumn("n_bytes", statistics.sparse_bytes("data"))
        return grid.recompose(kept, dims)

    QUERIES[f"roundtrip_stats_{key}"] = lambda spark, sf_dir: statistics.statistics(there_and_back(spark, sf_dir), dims, "ori", "data").drop("psnr")
    QUERIES[f"compression_ratio_{key}"] = lambda spark, sf_dir: statistics.statistics(compressed(spark, sf_dir), dims, "ori", "data", "n_bytes").select("grid_id", "max_error", "mse", "compression_ratio")
    there = formulas.decompose(DUCKDB, "data", dims, most)
    columns = statistics.statistic_columns(DUCKDB, "data", "dec", size)
    listed = ", ".join(f"{e} as {k}" for k, e in columns.items() if k != "psnr")
    source = f"with g as ({block_sql(dims)}), r as (select grid_id, data, {formulas.recompose(DUCKDB, there, dims, most)} as dec from g)"
    ORACLES[f"roundtrip_stats_{key}"] = f"{source} select grid_id, {listed} from r"
    dropped = f"q as (select grid_id, data, {there} as c from g), z as (select grid_id, data, list_transform(c, lambda x: case when abs(x) < {THRESHOLD}::double then 0.0::double else x end) as c from q)"
    n_bytes = f"(8 * len(list_filter(c, lambda x: x <> 0)) + {-(-size // 8)})"
    ORACLES[f"compression_ratio_{key}"] = f"with g as ({block_sql(dims)}), {dropped}, r as (select grid_id, data, {n_bytes} as n, {formulas.recompose(DUCKDB, 'c', dims, most)} as dec from z) select grid_id, {columns['max_error']} as max_error, {columns['mse']} as mse, {float(8 * size)!r}::double / n as compression_ratio from r"
    QUERIES[f"coarse_stats_{key}"] = lambda spark, sf_dir: statistics.statistics(coarse(spark, sf_dir, dims, most), dims, "ori", "data")
    ORACLES[f"coarse_stats_{key}"] = f"with g as ({block_sql(dims)}), q as (select grid_id, data, {there} as c from g), z as (select grid_id, data, {zero_sql(DUCKDB, 'c', dims, most)} as c from q), r as (select grid_id, data, {formulas.recompose(DUCKDB, 'c', dims, most)} as dec from z) select grid_id, {', '.join(f'{e} as {k}' for k, e in columns.items())} from r"


def register_gaps() -> None:
    """Statistics of grids with values that are no numbers, the first among them in every fifth grid."""
    broken = lambda x, k, nan: f"case when ({k} + grid_id) % 5 = 0 and {k} % 3 = 0 then {nan} else {x} end"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = blocks(spark, sf_dir, (64,)).withColumn("ori", F.expr(f"transform(data, (x, k) -> {broken('x', 'k', "double('NaN')")})"))
        return statistics.statistics(held.withColumn("dec", F.expr("transform(data, (x, k) -> x + k / 64.0D)")), (64,), "ori", "dec").select("grid_id", "max_value", "min_value", "max_error", "max_error_pos", F.isnan("mse").alias("mse_is_nan")).fillna({"max_value": 1e9, "min_value": 1e9})

    QUERIES["nan_stats_1d"] = query
    c = statistics.statistic_columns(DUCKDB, "ori", "dec", 64)
    tidy = lambda k: f"case when isnan({c[k]}) then 1e9::double else {c[k]} end as {k}"
    made = f"list_transform(range(0, 64), lambda k: {broken('data[k + 1]', 'k', repr('NaN') + '::double')})"
    ORACLES["nan_stats_1d"] = f"with g as ({block_sql((64,))}), r as (select grid_id, {made} as ori, list_transform(range(0, 64), lambda k: data[k + 1] + k / 64.0::double) as dec from g) select grid_id, {tidy('max_value')}, {tidy('min_value')}, {c['max_error']} as max_error, {c['max_error_pos']} as max_error_pos, isnan({c['mse']}) as mse_is_nan from r"


def zero_sql(d, a: str, dims: Sequence[int], most: int) -> str:
    """A decomposition without its finest coefficients."""
    shape = level_dims(dims, most)[-2]
    return formulas.over(d, a, dims, lambda x, p, c: f"case when {' and '.join(f'{k} < {n}' for k, n in zip(c, shape, strict=True))} then {d.at(x, p)} else {d.number(0.0)} end")


def coarse(spark: SparkSession, sf_dir: str, dims: Sequence[int], most: int) -> DataFrame:
    both = grid.decompose(blocks(spark, sf_dir, dims).withColumn("ori", F.col("data")), dims)
    return grid.recompose(both.withColumn("data", F.expr(zero_sql(SPARK, "data", dims, most))), dims)


def register_products() -> None:
    for key, dims in (("dot_product", (64,)), ("dot_product_3d", (4, 4, 4))):
        size = math.prod(dims)

        def query(spark: SparkSession, sf_dir: str, dims=dims, size=size) -> DataFrame:
            own = blocks(spark, sf_dir, dims)
            turned = grid.reorder(own.withColumn("ori", F.col("data")), dims)
            return grid.dot_product(turned, size, "ori", "data").select("grid_id", "dot")

        QUERIES[key] = query
        ORACLES[key] = f"with g as ({block_sql(dims)}) select grid_id, {formulas.dot(DUCKDB, 'data', formulas.reorder(DUCKDB, 'data', dims), size)} as dot from g"
    dims = (4, 4, 4)
    QUERIES["operator_norm_3d"] = lambda spark, sf_dir: grid.operator_norm(blocks(spark, sf_dir, dims), dims, 2, 0.5).select("grid_id", F.posexplode("norms").alias("level", "norm"))
    ORACLES["operator_norm_3d"] = f"with g as ({block_sql(dims)}), r as (select grid_id, {grid.operator_norm_steps(DUCKDB, 'data', dims, 2, 0.5)} as norms from g) select grid_id, unnest(range(0, 3))::int as level, unnest(norms) as norm from r"


def register_tables() -> None:
    wanted = {"G1": (64,), "G2": (8, 8), "G3": (4, 4, 4)}
    rows = [(name, k, axis, n) for name, dims in wanted.items() for k, shape in enumerate(grid.shapes_of(dims)) for axis, n in enumerate(shape)]
    QUERIES["levels_table"] = lambda spark, sf_dir: spark.createDataFrame(rows, "grid string, level int, axis int, n long")
    starts = " union all ".join(f"select '{g}' as grid, {axis} as axis, {n}::bigint as n, {LEVELS[key]} as level" for (g, dims), key in zip(wanted.items(), ("1d", "2d", "3d"), strict=True) for axis, n in enumerate(dims))
    ORACLES["levels_table"] = f"with recursive s as ({starts}), l as (select * from s union all select grid, axis, n // 2 + 1, level - 1 from l where level > 0) select grid, level, axis, n from l"
    sizes = [(n, len(grid.shapes_of((n,))) - 1) for n in range(3, 200)]
    QUERIES["depth_table"] = lambda spark, sf_dir: spark.createDataFrame(sizes, "n long, levels long")
    ORACLES["depth_table"] = "select n::bigint as n, floor(log2(n))::bigint as levels from range(3, 200) t(n)"
    factors = [(k, w, b) for k, (w, b) in enumerate(zip(*thomas_factors(33), strict=True))]
    QUERIES["thomas_factors"] = lambda spark, sf_dir: spark.createDataFrame(factors, "k int, w double, b double")
    ORACLES["thomas_factors"] = "with recursive t as (select 0 as k, 0.0::double as w, 2.0::double / 3.0::double as b union all select k + 1, (1.0::double / 3.0::double) / b, (case when k + 1 = 32 then 2.0::double / 3.0::double else 4.0::double / 3.0::double end) - ((1.0::double / 3.0::double) / b) * (1.0::double / 3.0::double) from t where k < 32) select * from t"


def register_files() -> None:
    """Raw files written and read again, and the printed forms of whole numbers."""

    def there_and_back(kind: str) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            folder = scratch(spark, "raw")
            raw.write_raw(blocks(spark, sf_dir, (64,)), folder, kind).write.format("noop").mode("overwrite").save()
            held = raw.read_raw(spark, folder, kind).withColumn("grid_id", F.regexp_extract("path", r"([-0-9]+)\.bin$", 1).cast("long"))
            return exploded(held.select("grid_id", "data"))

        return query

    for kind, real in (("double", "double"), ("float", "float")):
        QUERIES[f"raw_roundtrip_{kind}"] = there_and_back(kind)
        ORACLES[f"raw_roundtrip_{kind}"] = f"select grid_id, unnest(range(0, 64))::bigint as pos, unnest(data::{real}[]::double[]) as v from ({block_sql((64,))})"
    whole = "transform(data, x -> cast(floor(x * 100) as double))"
    QUERIES["print_matrix"] = lambda spark, sf_dir: raw.show_rows(blocks(spark, sf_dir, (8, 8)).withColumn("data", F.expr(whole)), 8)
    line = "list_transform(data, lambda x: floor(x * 100)::bigint::double::varchar)"
    ORACLES["print_matrix"] = f"select grid_id, k::int as row, array_to_string(({line})[8 * k + 1 : 8 * k + 8], ' ') as line from ({block_sql((8, 8))}), range(0, 8) t(k)"
    QUERIES["print_ragged"] = lambda spark, sf_dir: raw.show_ragged(blocks(spark, sf_dir, (64,)).withColumn("data", F.expr(f"slice({whole}, 1, cast(1 + grid_id % 60 as int))")))
    ORACLES["print_ragged"] = f"select grid_id, array_to_string(list_transform(range(0, 1 + grid_id % 60), lambda k: k::varchar || ':' || (floor(data[k + 1] * 100)::bigint::double::varchar)), ' ') as line from ({block_sql((64,))})"


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long grid: event values by event_id, which counts from 0 without gaps."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(0).cast("long").alias("grid_id"), F.col("event_id").alias("i1"), F.lit(0).cast("long").alias("i2"), F.lit(0).cast("long").alias("i3"), F.col("value").alias("v"))


#: Cells that the whole-table grids leave to one task: few, so that the small tables go through tiles as well.
IN_ONE_TASK = 4096


def register_large() -> None:
    """Whole-table grids: one long line in tiles and by the closed form of the solve, and lines, planes and boxes in tiles."""

    def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = line(spark, sf_dir)
        return tiles.decompose_large(cells, (cells.count(),), 1, "hierarchical", tile=4096, whole=0).select("i1", "v")

    QUERIES["hier_decompose_events_l1"] = hierarchical
    ORACLES["hier_decompose_events_l1"] = (
        "with e as (select event_id as i, value as v, count(*) over () as n from events), x as (select i, n, n // 2 + 1 as m, v, lag(v) over (order by i) as before, lead(v) over (order by i) as after from e), "
        "y as (select case when n % 2 = 0 and i = n - 1 then m - 1 when i % 2 = 0 then i // 2 else m + (i - 1) // 2 end as i1, case when n % 2 = 0 and i = n - 1 then 2.0::double * v - before when i % 2 = 0 then v "
        "else v - (before + after) / 2.0::double end as v from x) select i1::bigint as i1, v from y"
    )
    QUERIES["banded_solve_1d"] = lambda spark, sf_dir: banded.solve(line(spark, sf_dir), line(spark, sf_dir).count()).select("i1", "v")
    ORACLES["banded_solve_1d"] = banded.solve_sql("select event_id as i, value as v from events")

    def large(rank: int, back: bool) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            cells, dims = boxed(line(spark, sf_dir), rank)
            out = tiles.decompose_large(cells, dims, whole=IN_ONE_TASK)
            return scaled(tiles.recompose_large(out, dims, whole=IN_ONE_TASK), 100) if back else scaled(out, 10**6)

        return query

    def one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells, dims = boxed(line(spark, sf_dir), 2)
        return tiles.decompose_large(cells, dims, 1, "hierarchical", tile=64, whole=0).select("i1", "i2", "v")

    QUERIES["large_hier_decompose_2d_l1"] = one_level
    place = lambda i, n: f"case when {n} % 2 = 0 and {i} = {n} - 1 then {n} // 2 when {i} % 2 = 0 then {i} // 2 else {n} // 2 + 1 + {i} // 2 end"
    value = lambda i, n: f"case when {n} % 2 = 0 and {i} = {n} - 1 then 2.0::double * v - before else v end"
    ORACLES["large_hier_decompose_2d_l1"] = f"""{cells_sql(2)}, r as (select i1, i2, d1, d2, v, lag(v) over (partition by i1 order by i2) as before from c),
        a as (select i1, {place('i2', 'd2')} as q, d1, d2, {value('i2', 'd2')} as v from r),
        t as (select i1, q, d1, d2, v, lag(v) over (partition by q order by i1) as before from a),
        b as (select {place('i1', 'd1')} as p, q, d1 // 2 + 1 as m1, d2 // 2 + 1 as m2, {value('i1', 'd1')} as v from t),
        o as (select *, case when p < m1 then p else p - m1 end as p0, case when q < m2 then q else q - m2 end as q0 from b)
        select o.p::bigint as i1, o.q::bigint as i2, case when o.p < o.m1 and o.q < o.m2 then o.v when o.p < o.m1 then o.v - (x.v + y.v) / 2.0::double when o.q < o.m2 then o.v - (x.v + z.v) / 2.0::double
        else o.v - (x.v + y.v + z.v + w.v) / 4.0::double end as v from o
        join b x on x.p = o.p0 and x.q = o.q0 left join b y on y.p = o.p0 and y.q = o.q0 + 1 left join b z on z.p = o.p0 + 1 and z.q = o.q0 left join b w on w.p = o.p0 + 1 and w.q = o.q0 + 1"""
    for rank in (1, 2, 3):
        QUERIES[f"large_decompose_{rank}d"] = large(rank, False)
        QUERIES[f"large_roundtrip_{rank}d"] = large(rank, True)
        ORACLES[f"large_roundtrip_{rank}d"] = f"{cells_sql(rank)} select 0::bigint as grid_id, i1::bigint as i1, i2::bigint as i2, i3::bigint as i3, round(v * 100)::bigint as v from c"


def boxed(cells: DataFrame, rank: int) -> tuple[DataFrame, list[int]]:
    """A line as a box with axes of about one length, its last layers filled with zeros."""
    n = cells.count()
    dims = box_dims(n, rank)
    missing = cells.sparkSession.range(n, math.prod(dims)).select(F.lit(0).cast("long").alias("grid_id"), F.col("id").alias("i1"), F.lit(0).cast("long").alias("i2"), F.lit(0).cast("long").alias("i3"), F.lit(0.0).alias("v"))
    where = [formulas.coordinate(SPARK, "i1", dims, k) for k in range(rank)] + ["0"] * (3 - rank)
    return cells.union(missing).selectExpr("grid_id", *[f"cast({w} as bigint) as j{k + 1}" for k, w in enumerate(where)], "v").toDF("grid_id", "i1", "i2", "i3", "v"), dims


def scaled(cells: DataFrame, unit: int) -> DataFrame:
    """Values as whole numbers of 1 / unit, so that engines that sum in other orders agree."""
    return cells.withColumn("v", F.floor(F.col("v") * unit + 0.5))


def box_dims(n: int, rank: int) -> list[int]:
    """Axes of the whole root of n, the first as long as it takes."""
    side = next(k for k in range(round(n ** (1 / rank)) + 1, 0, -1) if k**rank <= n)
    rest = [side] * (rank - 1)
    return [-(-n // math.prod(rest)), *rest]


def cells_sql(rank: int) -> str:
    """The cells c of the events as such a box."""
    return f"with n as (select count(*)::bigint as n from events), s as (select {box_sql(rank)} from n), p as (select unnest(range(0, d1 * d2 * d3)) as p, d1, d2, d3 from s), c as (select p // (d2 * d3) as i1, p // d3 % d2 as i2, p % d3 as i3, d1, d2, coalesce(value, 0.0::double) as v from p left join events on event_id = p)"


def box_sql(rank: int) -> str:
    side = f"floor(n ** (1.0 / {rank}) + 1e-9)::bigint"
    rest = [side] * (rank - 1)
    return f"(n + {' * '.join(rest) or '1'} - 1) // ({' * '.join(rest) or '1'}) as d1, {rest[0] if rank > 1 else '1'} as d2, {rest[1] if rank > 2 else '1'} as d3"


register_grid_queries()
register_gaps()
register_products()
register_tables()
register_files()
register_large()
