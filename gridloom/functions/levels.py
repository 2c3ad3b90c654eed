"""Arithmetic of grid levels: lengths, depth, strides, and where a coefficient sits."""

from __future__ import annotations

import math
from collections.abc import Sequence


def check_dims(dims: Sequence[int]) -> list[int]:
    dims = [int(n) for n in dims]
    if not 1 <= len(dims) <= 3 or min(dims) < 1:
        raise ValueError(f"grids have one to three axes of positive length, not {dims}")
    return dims


def nodal(n: int) -> int:
    """Nodal points of an axis: every other point, and one extrapolated point if n is even."""
    return n // 2 + 1


def depth(dims: Sequence[int], levels: int | None = None) -> int:
    """Levels that are taken of those asked for: at most the whole part of the binary logarithm of the shortest axis, and none where that is 2 or less."""
    shortest = min(check_dims(dims))
    most = shortest.bit_length() - 1 if shortest > 2 else 0
    return most if levels is None else max(0, min(levels, most))


def level_dims(dims: Sequence[int], levels: int) -> list[list[int]]:
    """Box sizes, coarsest first; the last is the grid itself."""
    shapes = [check_dims(dims)]
    for _ in range(levels):
        shapes.append([nodal(n) for n in shapes[-1]])
    return shapes[::-1]


def strides(shape: Sequence[int]) -> list[int]:
    """Row-major strides."""
    return [math.prod(shape[d + 1 :]) for d in range(len(shape))]


def thomas_factors(m: int) -> tuple[list[float], list[float]]:
    """Multipliers and pivots of elimination on the mass matrix of m nodes."""
    pivots, multipliers = [2.0 / 3], [0.0]
    for k in range(1, m):
        w = (1.0 / 3) / pivots[-1]
        multipliers.append(w)
        pivots.append((2.0 / 3 if k == m - 1 else 4.0 / 3) - w * (1.0 / 3))
    return multipliers, pivots
