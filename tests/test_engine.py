"""The Spark operators against the kernels and, through the catalogue, against DuckDB."""

import math
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import catalogue
from gridloom.operators import banded, grid, kernels, statistics, tiles
from gridloom.sources import raw
from gridloom.streaming.grids import decompose_to_parquet

SF = "/root/testdata/sf0.001"


def frame(spark, x):
    rows = [(k, [float(v) for v in g.ravel()]) for k, g in enumerate(x)]
    return spark.createDataFrame(rows, "grid_id long, data array<double>")


def values(df):
    return np.array([r["data"] for r in df.orderBy("grid_id").collect()])


@pytest.mark.parametrize("dims", [(9,), (6, 5), (3, 4, 5)])
@pytest.mark.parametrize("basis", ["l2", "hierarchical"])
def test_expressions_equal_kernels(spark, dims, basis):
    x = np.random.default_rng(3).standard_normal((3, *dims))
    want = kernels.decompose(x, None, basis == "l2").reshape(3, -1)
    df = frame(spark, x)
    assert (values(grid.decompose(df, dims, basis=basis, strategy="expressions")) == want).all()
    assert (values(grid.decompose(df, dims, basis=basis, strategy="arrow")) == want).all()
    back = grid.recompose(frame(spark, want), dims, basis=basis, strategy="expressions")
    assert (values(back) == values(grid.recompose(frame(spark, want), dims, basis=basis))).all()
    np.testing.assert_allclose(values(back), x.reshape(3, -1), atol=1e-12)


@pytest.mark.parametrize("name", ["nan_stats_1d", "large_hier_decompose_2d_l1", "copy_box_2d_inner", "decompose_box_2d", "recompose_box_2d_inner", "float_decompose_2d", "raw_roundtrip_float", "print_matrix", "print_ragged", "depth_table", "banded_solve_1d", "large_roundtrip_2d", "compression_ratio_1d", "l2_decompose_1d_odd_full", "reorder_2d", "unreorder_3d_odd", "residual_2d_mixed", "l2_correction_2d", "restriction_2d_odd", "progressive_2d", "decomposed_form_2d", "roundtrip_stats_1d", "dot_product_3d", "operator_norm_3d", "levels_table", "thomas_factors", "hier_decompose_events_l1", "load_vector_vertical", "mass_solve"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(map(tuple, ours[sorted(ours.columns)].to_numpy().tolist())) == sorted(map(tuple, theirs[sorted(ours.columns)].to_numpy().tolist()))


@pytest.mark.parametrize("dims", [(1000,), (150, 140), (9, 10, 300)])
def test_tiles_equal_kernels(spark, dims):
    x = np.random.default_rng(5).standard_normal((1, *dims))
    cells = grid.to_long(frame(spark, x), dims)
    got = tiles.decompose_large(cells, dims, 2, tile=64, whole=0)
    want = kernels.decompose(x, 2, True)[0]
    out = np.full(dims, np.nan)
    for r in got.collect():
        out[tuple([r["i1"], r["i2"], r["i3"]][: len(dims)])] = r["v"]
    np.testing.assert_allclose(out, want, atol=1e-11)
    back = tiles.recompose_large(got, dims, 2, tile=64, whole=0).toPandas()
    assert len(back) == math.prod(dims)
    np.testing.assert_allclose(back["v"], x[0][tuple(back[f"i{k + 1}"] for k in range(len(dims)))], atol=1e-10)


@pytest.mark.parametrize(("dims", "tile", "line", "whole"), [((400,), 64, 40, 0), ((90, 130), 32, 20, 4000), ((33, 40, 50), 16, 8, 0), ((33, 40), 16, 8, 9999)])
def test_small_stretches(spark, dims, tile, line, whole):
    """Lines solved in many short stretches, both bases, to full depth and back."""
    x = np.random.default_rng(6).standard_normal((1, *dims))
    cells = grid.to_long(frame(spark, x), dims)
    for basis in grid.BASES:
        got = tiles.decompose_large(cells, dims, 2, basis, tile=tile, line=line, whole=whole)
        out = np.full(dims, np.nan)
        for r in got.collect():
            out[tuple([r["i1"], r["i2"], r["i3"]][: len(dims)])] = r["v"]
        np.testing.assert_allclose(out, kernels.decompose(x, 2, basis == "l2")[0], atol=1e-11)
        back = tiles.recompose_large(got, dims, 2, basis, tile=tile, line=line, whole=whole).toPandas()
        np.testing.assert_allclose(back["v"], x[0][tuple(back[f"i{k + 1}"] for k in range(len(dims)))], atol=1e-10)


def test_bad_cells_are_refused(spark):
    cells = [(0, k, 0, 0, float(k)) for k in range(30)]
    kind = "grid_id long, i1 long, i2 long, i3 long, v double"
    for rows, whole in product((cells[:7] + cells[8:], [*cells, cells[3]], [*cells[:9], (0, 9, 0, 0, None), *cells[10:]]), (0, 99)):
        with pytest.raises(Exception, match="lacks cells or holds some twice|holds nulls"):
            tiles.decompose_large(spark.createDataFrame(rows, kind), (30,), 1, whole=whole).collect()
    with pytest.raises(ValueError, match="basis"):
        tiles.decompose_large(spark.createDataFrame(cells, kind), (30,), 1, basis="L2 ")


def test_banded_solve(spark):
    x = np.random.default_rng(9).standard_normal((1, 300))
    cells = grid.to_long(frame(spark, x), (300,))
    got = banded.solve(cells, 300, stretch=64).orderBy("i1").collect()
    np.testing.assert_allclose([r["v"] for r in got], kernels.solve_axis(x, 1)[0], atol=1e-12)
    with pytest.raises(Exception, match="lacks points or holds some twice"):
        banded.solve(cells.where("i1 <> 70"), 300, stretch=64).collect()


@pytest.mark.parametrize("strategy", grid.STRATEGIES)
def test_boxes(spark, strategy):
    """A box inside a larger array is transformed as a grid of its own, the rest stays."""
    x = np.random.default_rng(10).standard_normal((2, 7, 8))
    want = x.copy()
    want[:, 1:6, 2:8] = kernels.decompose(x[:, 1:6, 2:8], None, True)
    got = grid.decompose(frame(spark, x), (5, 6), buffer=(7, 8), origin=(1, 2), strategy=strategy)
    assert (values(got) == want.reshape(2, -1)).all()
    back = grid.recompose(got, (5, 6), buffer=(7, 8), origin=(1, 2), strategy=strategy)
    np.testing.assert_allclose(values(back), x.reshape(2, -1), atol=1e-12)
    assert (values(grid.copy_box(frame(spark, x), (5, 6), (7, 8), (1, 2))) == x[:, 1:6, 2:8].reshape(2, -1)).all()
    with pytest.raises(ValueError, match="does not lie inside"):
        grid.decompose(frame(spark, x), (5, 6), buffer=(7, 8), origin=(3, 2))


@pytest.mark.parametrize("step", ["reorder", "unreorder", "residual", "l2_correction", "restriction"])
def test_steps_by_either_strategy(spark, step):
    x = np.random.default_rng(12).standard_normal((3, 6, 5))
    held = {s: values(getattr(grid, step)(frame(spark, x), (6, 5), strategy=s)) for s in grid.STRATEGIES}
    assert (held["arrow"] == held["expressions"]).all()


def test_bad_grids_are_refused(spark):
    for rows in ([(1, [1.0, None, 2.0])], [(1, [1.0])], [(1, None)]):
        with pytest.raises(Exception, match="grid needs"):
            grid.decompose(spark.createDataFrame(rows, "grid_id long, data array<double>"), (3,)).collect()


def test_levels_on_disk(spark, tmp_path):
    dims = (9, 8)
    x = np.random.default_rng(2).standard_normal((2, *dims))
    grid.to_decomposed(grid.decompose(frame(spark, x), dims), dims).write.partitionBy("level").parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    shape = (5, 5)
    coarse = grid.recompose(grid.from_decomposed(stored, dims, upto=2), shape, 2)
    want = grid.progressive(grid.decompose(frame(spark, x), dims), dims, 2)
    np.testing.assert_allclose(values(coarse), values(want), atol=1e-12)
    assert "PartitionFilters: [isnotnull(level" in grid.from_decomposed(stored, dims, upto=0)._jdf.queryExecution().toString()


def test_raw_files(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((3, 5))
    done = raw.write_raw(frame(spark, x), str(tmp_path)).collect()
    assert sorted(r["n_bytes"] for r in done) == [40, 40, 40]
    with pytest.raises(Exception, match="is null or holds nulls"):
        raw.write_raw(spark.createDataFrame([(1, [1.0]), (2, None)], "grid_id long, data array<double>"), str(tmp_path / "bad")).collect()
    (tmp_path / "odd.bin").write_bytes(np.array([1.5, 2.5]).tobytes() + b"xyz")
    got = {r["path"].rsplit("/", 1)[1]: r["data"] for r in raw.read_raw(spark, str(tmp_path)).collect()}
    assert got["odd.bin"] == [1.5, 2.5]
    assert got["1.bin"] == x[1].tolist()
    assert raw.show_rows(frame(spark, np.arange(6.0)[None]), 3).orderBy("row").collect()[1]["line"] == "3.0 4.0 5.0"
    assert raw.show_ragged(frame(spark, np.arange(2.0)[None])).first()["line"] == "0:0.0 1:1.0"


def test_statistics(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 5.0], [1.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])], "grid_id long, a array<double>, b array<double>")
    first, exact = statistics.statistics(df, (3,), "a", "b").orderBy("grid_id").collect()
    assert (first["max_value"], first["min_value"], first["max_error"], first["max_error_pos"]) == (5, 1, 1, 1)
    assert first["psnr"] == pytest.approx(20 * math.log10(4 / math.sqrt(2 / 3)))
    assert exact["psnr"] is None
    long = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 2.0, 3.0), (1, 2, 5.0, 4.0)], "grid_id long, pos long, v double, w double")
    assert statistics.long_statistics(long).first()["max_error_pos"] == 1


def test_statistics_with_gaps(spark):
    nan = float("nan")
    rows = [(1, [1.0, nan, 5.0], [1.0, 3.0, 4.0]), (2, [nan, 2.0, 3.0], [0.0, 2.5, 3.0]), (3, [nan] * 3, [1.0] * 3)]
    want = {1: (5.0, 1.0, 1.0, 2), 2: (nan, nan, 0.5, 1), 3: (nan, nan, 0.0, 0)}
    df = spark.createDataFrame(rows, "grid_id long, a array<double>, b array<double>")
    long = spark.createDataFrame([(g, k, x, y) for g, a, b in rows for k, (x, y) in enumerate(zip(a, b, strict=True))], "grid_id long, pos long, v double, w double")
    for got in (statistics.statistics(df, (3,), "a", "b").collect(), statistics.long_statistics(long).collect()):
        for r in got:
            np.testing.assert_array_equal([r["max_value"], r["min_value"], r["max_error"], r["max_error_pos"]], want[r["grid_id"]])
            assert math.isnan(r["mse"])


def test_stream(spark, tmp_path):
    x = np.random.default_rng(6).standard_normal((4, 9))
    frame(spark, x).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("grid_id long, data array<double>").parquet(str(tmp_path / "in"))
    decompose_to_parquet(stream, (9,), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("level") == 0).count() == 4 * 2


def test_way_back_reads_each_cell_once(spark):
    """All levels together take one pass over the cells given, so tasks do not grow with levels times tables."""
    n, read = 300, spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    rows = [(0, i, 0, 0, float(i * i % 17)) for i in range(n)]
    there = tiles.decompose_large(spark.createDataFrame(rows, tiles.CELLS), (n,), tile=32, line=64, whole=16)
    cells = spark.createDataFrame(there.rdd.map(counted), tiles.CELLS)
    back = tiles.recompose_large(cells, (n,), tile=32, line=64, whole=16)
    got = sorted((r["i1"], r["v"]) for r in back.collect())
    assert [i for i, _ in got] == list(range(n))
    assert max(abs(v - i * i % 17) for i, v in got) < 1e-9
    assert read.value == n
