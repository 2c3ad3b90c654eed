"""One level of the transform on numpy stacks of grids, shape (grids, n1[, n2[, n3]]), in the stack's own precision."""

from __future__ import annotations

from itertools import product

import numpy as np

from gridloom.functions.levels import depth, level_dims, nodal, thomas_factors
from gridloom.plans.formulas import corner_steps


def part(x: np.ndarray, axis: int, *where) -> np.ndarray:
    """x at slice(*where) of one axis, or at one place of it."""
    at = [slice(None)] * x.ndim
    at[axis] = where[0] if len(where) == 1 else slice(*where)
    return x[tuple(at)]


def reorder_axis(x: np.ndarray, axis: int) -> np.ndarray:
    n = x.shape[axis]
    evens, odds = part(x, axis, 0, n, 2), part(x, axis, 1, n, 2)
    if n % 2:
        return np.concatenate([evens, odds], axis)
    ghost = 2 * part(x, axis, n - 1, n) - part(x, axis, n - 2, n - 1)
    return np.concatenate([evens, ghost, part(odds, axis, 0, n // 2 - 1)], axis)


def unreorder_axis(x: np.ndarray, axis: int) -> np.ndarray:
    n, m = x.shape[axis], nodal(x.shape[axis])
    out = np.empty_like(x)
    part(out, axis, 0, n, 2)[...] = part(x, axis, 0, (n + 1) // 2)
    part(out, axis, 1, 2 * (n - m), 2)[...] = part(x, axis, m, n)
    if n % 2 == 0:
        part(out, axis, n - 1, n)[...] = (part(x, axis, m - 2, m - 1) + part(x, axis, m - 1, m)) / 2
    return out


def residual(x: np.ndarray, sign: int) -> np.ndarray:
    shape = x.shape[1:]
    ms = [nodal(n) for n in shape]
    out = x.copy()
    for mask in product((False, True), repeat=len(shape)):
        if any(mask):
            total = None
            for step in corner_steps(mask):
                at = tuple(slice(s, s + n - m) if on else slice(0, m) for on, n, m, s in zip(mask, shape, ms, step, strict=True))
                total = x[(slice(None), *at)] if total is None else total + x[(slice(None), *at)]
            box = (slice(None), *(slice(m, n) if on else slice(0, m) for on, n, m in zip(mask, shape, ms, strict=True)))
            out[box] = x[box] + sign * (total / x.dtype.type(2 ** sum(mask)))
    return out


def load_axis(x: np.ndarray, axis: int) -> np.ndarray:
    n, m = x.shape[axis], nodal(x.shape[axis])
    c, t = n - m, x.dtype.type
    nod, coef = part(x, axis, 0, c + 1), part(x, axis, m, n)
    out = np.zeros_like(part(x, axis, 0, m))
    part(out, axis, 0, 1)[...] = part(nod, axis, 1, 2) * t(1.0 / 12) + part(coef, axis, 0, 1) * t(0.5) + part(nod, axis, 0, 1) * t(5.0 / 12)
    part(out, axis, c, c + 1)[...] = part(nod, axis, c - 1, c) * t(1.0 / 12) + part(coef, axis, c - 1, c) * t(0.5) + part(nod, axis, c, c + 1) * t(5.0 / 12)
    part(out, axis, 1, c)[...] = (part(nod, axis, 0, c - 1) + part(nod, axis, 2, c + 1)) * t(1.0 / 12) + (part(coef, axis, 0, c - 1) + part(coef, axis, 1, c)) * t(0.5) + part(nod, axis, 1, c) * t(5.0 / 6)
    return out


def solve_axis(x: np.ndarray, axis: int) -> np.ndarray:
    m, t = x.shape[axis], x.dtype.type
    w, b = thomas_factors(m)
    out = x.copy()
    for k in range(1, m):
        part(out, axis, k)[...] -= t(w[k]) * part(out, axis, k - 1)
    part(out, axis, m - 1)[...] /= t(b[m - 1])
    for k in range(m - 2, -1, -1):
        part(out, axis, k)[...] = (part(out, axis, k) - t(1.0 / 3) * part(out, axis, k + 1)) / t(b[k])
    return out


def corner(x: np.ndarray) -> tuple:
    return (slice(None), *(slice(0, nodal(n)) for n in x.shape[1:]))


def correction(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[corner(x)] = 0
    for axis in range(x.ndim - 1, 0, -1):
        out = solve_axis(load_axis(out, axis), axis)
    return out


def reorder(x: np.ndarray) -> np.ndarray:
    for axis in range(x.ndim - 1, 0, -1):
        x = reorder_axis(x, axis)
    return x


def unreorder(x: np.ndarray) -> np.ndarray:
    for axis in range(x.ndim - 1, 0, -1):
        x = unreorder_axis(x, axis)
    return x


def restriction(x: np.ndarray) -> np.ndarray:
    """Half of each neighbouring coefficient onto the nodal values, axis by axis; the last axis in nodal rows of the axis before alone."""
    x, shape = x.copy(), x.shape[1:]
    ms, last = [nodal(n) for n in shape], len(shape) - 1
    for axis in range(last, -1, -1):
        within = [ms[k] if k > axis or (axis == last and k == last - 1) else n for k, n in enumerate(shape)]
        at = (slice(None), *(slice(None) if k == axis else slice(0, n) for k, n in enumerate(within)))
        y, m, c = x[at], ms[axis], shape[axis] - ms[axis]
        if not c:
            continue
        coef = part(y, axis + 1, m, m + c)
        out = y.copy()
        part(out, axis + 1, 0, 1)[...] += part(coef, axis + 1, 0, 1) / 2
        part(out, axis + 1, 1, c)[...] += (part(coef, axis + 1, 0, c - 1) + part(coef, axis + 1, 1, c)) / 2
        part(out, axis + 1, c, c + 1)[...] += part(coef, axis + 1, c - 1, c) / 2
        x[at] = out
    return x


def decompose_level(x: np.ndarray, l2: bool) -> np.ndarray:
    x = residual(reorder(x), -1)
    if l2:
        x[corner(x)] += correction(x)
    return x


def recompose_level(x: np.ndarray, l2: bool) -> np.ndarray:
    x = x.copy()
    if l2:
        x[corner(x)] -= correction(x)
    return unreorder(residual(x, 1))


def decompose(x: np.ndarray, levels: int | None, l2: bool) -> np.ndarray:
    x = x.copy()
    taken = depth(x.shape[1:], levels)
    for shape in reversed(level_dims(x.shape[1:], taken)[1:]):
        at = (slice(None), *(slice(0, n) for n in shape))
        x[at] = decompose_level(x[at], l2)
    return x


def recompose(x: np.ndarray, levels: int | None, l2: bool) -> np.ndarray:
    x = x.copy()
    taken = depth(x.shape[1:], levels)
    for shape in level_dims(x.shape[1:], taken)[1:]:
        at = (slice(None), *(slice(0, n) for n in shape))
        x[at] = recompose_level(x[at], l2)
    return x
