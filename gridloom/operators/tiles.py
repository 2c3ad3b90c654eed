"""One level at a time on grids too large for an executor, in long form.

A level is separable. Reordering and residuals look one point to each side, so a grid
is cut into tiles with a margin of MARGIN points. The L2 correction is a load vector and
a tridiagonal solve along one axis after another: for each, the box is cut into bundles
of lines along that axis, lines beyond LINE nodes into stretches with REACH nodes more on
each side, past which the inverse mass matrix, decaying by 0.268 a node, is below double
precision. So cells are repeated only at the edges of tiles, whatever the rank; in three
dimensions about 3 cells are shuffled for each cell of a level, all passes together.
The nodal cells, a 2^rank-th of all, go on to the next level; once a grid's box holds no
more than WHOLE cells, the levels left are taken in one task for each grid. On the way
back the cells are first written by level, so that each level reads its own cells alone.

A tile that does not hold every cell exactly once is an error, and so are null values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.levels import check_dims, depth, level_dims, nodal
from gridloom.functions.session import drop, ready, scratch, tidy

from . import kernels
from .grid import is_l2

#: Core points of a tile's edge by rank, and the margin; all even.
TILE, MARGIN = {1: 65536, 2: 512, 3: 96}, 2
#: Nodes of a line that are solved together, nodes beyond on each side, and by rank the lines of a bundle along each other axis.
LINE, REACH, BUNDLE = 4096, 32, {1: 1, 2: 64, 3: 12}
#: Cells of a box that one task transforms to the end.
WHOLE = 1 << 18
CELLS = "grid_id long, i1 long, i2 long, i3 long, v double"
AXES = ("i1", "i2", "i3")


def scattered(cells: pa.Table, at: np.ndarray, shape: Sequence[int], empty: np.ndarray | None = None) -> np.ndarray:
    """The cells as an array, each place filled once but for those where ``empty`` holds, which are 0."""
    flat = np.ravel_multi_index(at.T, shape)
    times = np.bincount(flat, minlength=math.prod(shape)).reshape(shape)
    if (times != (1 if empty is None else ~empty)).any():
        raise ValueError("a grid lacks cells or holds some twice")
    out = np.zeros(math.prod(shape))
    out[flat] = cells.column("v").to_numpy()
    return out.reshape(shape)


def listed(grid_id: int, names: Sequence[np.ndarray], values: np.ndarray) -> pa.Table:
    """Cells of an array whose places along each axis are called by names."""
    spread = np.meshgrid(*names, indexing="ij")
    columns = [spread[k].ravel().astype(np.int64) if k < len(names) else np.zeros(values.size, np.int64) for k in range(3)]
    return pa.table({"grid_id": np.full(values.size, grid_id, np.int64), **dict(zip(AXES, columns, strict=True)), "v": values.ravel()})


def places(cells: pa.Table, rank: int) -> np.ndarray:
    return np.stack([cells.column(a).to_numpy() for a in AXES[:rank]], axis=1)


def dealt(cells: DataFrame, shape: Sequence[int], tile: int, points: Sequence[Column]) -> DataFrame:
    """Cells beside every tile (t1..t3) whose core and margin hold the points."""
    out = cells
    for axis in range(3):
        name = f"t{axis + 1}"
        if axis >= len(shape):
            out = out.withColumn(name, F.lit(0))
            continue
        last = max(0, -(-shape[axis] // tile) - 1)
        low = F.greatest(F.lit(0), F.floor((points[axis] - MARGIN - 1) / tile))
        high = F.least(F.lit(last), F.floor((points[axis] + MARGIN) / tile))
        out = out.withColumn(name, F.explode(F.sequence(F.least(low, F.lit(last)).cast("int"), high.cast("int"))))
    return out


def span(n: int, tile: int, t: int) -> tuple[int, int]:
    """First point and end of a tile with margins; an inner end leaves an odd length, so it closes on a nodal point."""
    return max(t * tile - MARGIN, 0), min((t + 1) * tile + MARGIN + 1, n)


def tile_residuals(shape: Sequence[int], tile: int, forward: bool):
    """A tile's cells to those of its core: points to residuals in the level's layout, or (not forward) back."""
    rank, ms = len(shape), [nodal(n) for n in shape]

    def run(key, cells):
        ts = [int(k.as_py()) for k in key[1 : 1 + rank]]
        spans = [span(n, tile, t) for n, t in zip(shape, ts, strict=True)]
        at = places(cells, rank)
        local = np.empty_like(at)
        for k, (a, b) in enumerate(spans):
            i = at[:, k]
            if forward:
                local[:, k] = i - a
            else:  # layout to the tile's own layout: nodal, then coefficients
                m = nodal(b - a)
                node, coef = i - a // 2, i - ms[k] - a // 2
                local[:, k] = np.where(i < ms[k], np.where((node >= 0) & (node < m), node, -1), np.where((coef >= 0) & (coef < b - a - m), m + coef, -1))
        size = [b - a for a, b in spans]
        ok = ((local >= 0) & (local < size)).all(axis=1)
        x = scattered(cells.filter(pa.array(ok)), local[ok], size)[None]
        x = (kernels.decompose_level if forward else kernels.recompose_level)(x, False)[0]
        keep, name = [], []
        for k, (a, b) in enumerate(spans):
            j, m = np.arange(b - a), nodal(b - a)
            low, high = ts[k] * tile, (ts[k] + 1) * tile if (ts[k] + 1) * tile < shape[k] else shape[k] + 2
            point = np.where(j < m, 2 * j, 2 * (j - m) + 1) + a if forward else j + a
            on = np.flatnonzero((point >= low) & (point < high))
            keep.append(on)
            name.append(np.where(j < m, j + a // 2, ms[k] + j - m + a // 2)[on] if forward else point[on])
        return listed(key[0].as_py(), name, x[np.ix_(*keep)])

    return run


def residuals(cells: DataFrame, shape: Sequence[int], tile: int, forward: bool) -> DataFrame:
    axes = [F.col(a) for a in AXES[: len(shape)]]
    points = axes if forward else [F.when(i < nodal(n), 2 * i).otherwise(2 * (i - nodal(n)) + 1) for i, n in zip(axes, shape, strict=True)]
    return dealt(cells, shape, tile, points).groupBy("grid_id", "t1", "t2", "t3").applyInArrow(tile_residuals(shape, tile, forward), CELLS)


def solved(cells: DataFrame, shape: Sequence[int], axis: int, line: int, first: bool) -> DataFrame:
    """Load vector and solve along an axis of a box in layout; if first, the nodal corner is absent and counts as 0."""
    rank, n, m = len(shape), shape[axis], nodal(shape[axis])
    ms, c_count, bundle = [nodal(k) for k in shape], n - m, BUNDLE[len(shape)]
    last = max(0, -(-m // line) - 1)
    index = F.when(F.col(AXES[axis]) < m, F.col(AXES[axis])).otherwise(F.col(AXES[axis]) - m)
    low = F.least(F.greatest(F.floor((index - REACH - 1) / line), F.lit(0)), F.lit(last))
    high = F.least(F.floor((index + REACH) / line), F.lit(last))
    keyed = cells.withColumn(f"t{axis + 1}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    for k in range(3):
        if k != axis:
            keyed = keyed.withColumn(f"t{k + 1}", F.expr(f"cast({AXES[k]} div {bundle} as int)") if k < rank else F.lit(0))

    def run(key, held):
        ts = [int(k.as_py()) for k in key[1 : 1 + rank]]
        a, b = max(ts[axis] * line - REACH, 0), min((ts[axis] + 1) * line + REACH, m)
        coefs = min(b - 1, c_count) - a  # inner ends close on a node
        starts = [0 if k == axis else ts[k] * bundle for k in range(rank)]
        size = [b - a + coefs if k == axis else min(bundle, shape[k] - starts[k]) for k in range(rank)]
        at = places(held, rank) - np.array(starts)
        i = at[:, axis].copy()
        node, coef = i - a, i - m - a
        at[:, axis] = np.where(i < m, np.where((node >= 0) & (node < b - a), node, -1), np.where((coef >= 0) & (coef < coefs), b - a + coef, -1))
        ok = at[:, axis] >= 0
        empty = None
        if first:
            nodal_here = [np.arange(size[k]) < (b - a) if k == axis else np.arange(size[k]) + starts[k] < ms[k] for k in range(rank)]
            empty = reduce(np.multiply.outer, nodal_here)
        x = scattered(held.filter(pa.array(ok)), at[ok], size, empty)[None]
        x = kernels.solve_axis(kernels.load_axis(x, axis + 1), axis + 1)[0]
        core = slice(ts[axis] * line - a, min((ts[axis] + 1) * line, m) - a)
        names = [np.arange(size[k]) + starts[k] if k != axis else np.arange(b - a)[core] + a for k in range(rank)]
        return listed(key[0].as_py(), names, kernels.part(x, axis, core.start, core.stop))

    return keyed.groupBy("grid_id", "t1", "t2", "t3").applyInArrow(run, CELLS)


def inside(shape: Sequence[int]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"i{k + 1}") < n for k, n in enumerate(shape)])


def corrected(cells: DataFrame, shape: Sequence[int], sign: int, line: int) -> DataFrame:
    """A checkpointed box of residuals with its nodal corner raised (sign 1) or lowered by the L2 correction."""
    corner, box, left = [nodal(n) for n in shape], cells.where(~inside([nodal(n) for n in shape])), list(shape)
    for axis in reversed(range(len(shape))):
        box = solved(box, left, axis, line, axis == len(shape) - 1)
        left[axis] = corner[axis]
    change = box.select(*["grid_id", *AXES], (F.lit(float(sign)) * F.col("v")).alias("d"))
    raised = cells.where(inside(corner)).join(change, ["grid_id", *AXES]).select("grid_id", *AXES, (F.col("v") + F.col("d")).alias("v"))
    return cells.where(~inside(corner)).union(raised)


def started(cells: DataFrame) -> DataFrame:
    value = F.when(F.col("v").isNull(), F.raise_error(F.lit("a grid holds nulls")).cast("double")).otherwise(F.col("v").cast("double"))
    return cells.select(F.col("grid_id").cast("long"), *[F.col(a).cast("long") for a in AXES], value.alias("v"))


def at_once(cells: DataFrame, shape: Sequence[int], kernel) -> DataFrame:
    """The kernel on the whole box of each grid."""

    def run(key, held):
        x = scattered(held, places(held, len(shape)), shape)[None]
        return listed(key[0].as_py(), [np.arange(n) for n in shape], kernel(x)[0])

    return cells.groupBy("grid_id").applyInArrow(run, CELLS)


def by_level(cells: DataFrame, shapes: Sequence[Sequence[int]], path: str) -> DataFrame:
    """The cells written with the level (k) of the least of the shapes that holds them; a filter on k reads one level's files."""
    level = reduce(lambda w, k: w.when(inside(shapes[k]), F.lit(k)), range(1, len(shapes)), F.when(inside(shapes[0]), F.lit(0)))
    cells.withColumn("k", level).where("k is not null").write.partitionBy("k").parquet(path)
    return cells.sparkSession.read.schema(f"{CELLS}, k int").parquet(path)


def decompose_large(cells: DataFrame, dims: Sequence[int], levels: int | None = None, basis: str = "l2", tile: int | None = None, line: int = LINE, whole: int = WHOLE) -> DataFrame:
    """(grid_id, i1, i2, i3, v) of whole grids to their decomposition in the same form, cells being places in the layout."""
    dims, l2 = check_dims(dims), is_l2(basis)
    ready(cells.sparkSession)
    tile = tile or TILE[len(dims)]
    shapes = level_dims(dims, depth(dims, levels))
    done, rest = None, started(cells)
    for k in range(len(shapes) - 1, 0, -1):
        if math.prod(shapes[k]) <= whole:
            rest = at_once(rest, shapes[k], lambda x, k=k: kernels.decompose(x, k, l2))
            break
        level = residuals(rest, shapes[k], tile, True).checkpoint()
        if l2:
            level = corrected(level, shapes[k], 1, line).checkpoint()
        tidy(cells.sparkSession)
        shell = level.where(~inside(shapes[k - 1]))
        done, rest = shell if done is None else done.union(shell), level.where(inside(shapes[k - 1]))
    return rest if done is None else done.union(rest)


def recompose_large(cells: DataFrame, dims: Sequence[int], levels: int | None = None, basis: str = "l2", tile: int | None = None, line: int = LINE, whole: int = WHOLE) -> DataFrame:
    """The inverse of decompose_large."""
    dims, l2, spark = check_dims(dims), is_l2(basis), cells.sparkSession
    ready(spark)
    tile = tile or TILE[len(dims)]
    shapes, cells = level_dims(dims, depth(dims, levels)), started(cells)
    done = max((k for k, shape in enumerate(shapes) if math.prod(shape) <= whole), default=0)
    path = scratch(spark, "levels") if len(shapes) > done + 1 else None
    held = by_level(cells, shapes[done:], path) if path else cells.where(inside(shapes[done])).withColumn("k", F.lit(0))
    box = held.where("k = 0").drop("k")
    if done:
        box = at_once(box, shapes[done], lambda x: kernels.recompose(x, done, l2))
    for k, shape in enumerate(shapes[done + 1 :], 1):
        box = box.union(held.where(F.col("k") == k).drop("k"))
        if l2:
            box = corrected(box, shape, -1, line)
        box = residuals(box, shape, tile, False).checkpoint()
        tidy(spark)
    if path:
        drop(spark, path)
    return box
