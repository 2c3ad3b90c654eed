"""Grid operators as expressions over flat row-major arrays.

Every function takes the SQL text of an array, the shape of the box that it holds and
a dialect, and gives the SQL text of the result. Shapes are known when the plan is
made, so an index is plain integer arithmetic; intermediate arrays are bound with
``let`` so that each is worked out once per grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import count, product

from gridloom.functions.levels import level_dims, nodal, strides, thomas_factors

from .dialect import Dialect

_names = count()


def fresh(prefix: str) -> str:
    return f"{prefix}{next(_names)}"


def coordinate(d: Dialect, p: str, shape: Sequence[int], axis: int) -> str:
    s = strides(shape)[axis]
    return f"({d.div(p, s)} % {shape[axis]})" if axis else d.div(p, s)


def index(terms: Sequence[str], shape: Sequence[int]) -> str:
    """Flat index from coordinates."""
    return " + ".join(f"({t}) * {s}" for t, s in zip(terms, strides(shape), strict=True))


def with_coordinates(d: Dialect, p: str, shape: Sequence[int], body) -> str:
    """body(names of the coordinates of flat index p)."""
    names = [fresh("c") for _ in shape]
    out = body(names)
    for axis, name in enumerate(names):
        out = d.let(name, coordinate(d, p, shape, axis), out)
    return out


def over(d: Dialect, a: str, out_shape: Sequence[int], body) -> str:
    """An array of out_shape whose value at each point is body(array name, p, coordinates)."""
    x, p = fresh("a"), fresh("p")
    return d.let(x, a, d.build(math.prod(out_shape), p, with_coordinates(d, p, out_shape, lambda c: body(x, p, c))))


def moved(d: Dialect, x: str, c: Sequence[str], shape: Sequence[int], axis: int, to: str) -> str:
    """x at the coordinates c with that of one axis replaced."""
    return d.at(x, index([to if k == axis else name for k, name in enumerate(c)], shape))


def reorder_axis(d: Dialect, a: str, shape: Sequence[int], axis: int) -> str:
    n, m = shape[axis], nodal(shape[axis])
    two = d.number(2.0)

    def body(x: str, p: str, c: list[str]) -> str:
        k = c[axis]
        ghost = f"when {k} = {m - 1} then {two} * {moved(d, x, c, shape, axis, str(n - 1))} - {moved(d, x, c, shape, axis, str(n - 2))} " if n % 2 == 0 else ""
        return f"case {ghost}when {k} < {m} then {moved(d, x, c, shape, axis, f'2 * {k}')} else {moved(d, x, c, shape, axis, f'2 * ({k} - {m}) + 1')} end"

    return over(d, a, shape, body)


def unreorder_axis(d: Dialect, a: str, shape: Sequence[int], axis: int) -> str:
    n, m = shape[axis], nodal(shape[axis])

    def body(x: str, p: str, c: list[str]) -> str:
        k = c[axis]
        last = f"when {k} = {n - 1} then ({moved(d, x, c, shape, axis, str(m - 2))} + {moved(d, x, c, shape, axis, str(m - 1))}) / {d.number(2.0)} " if n % 2 == 0 else ""
        return f"case {last}when {k} % 2 = 0 then {moved(d, x, c, shape, axis, d.div(k, 2))} else {moved(d, x, c, shape, axis, f'{m} + {d.div(k, 2)}')} end"

    return over(d, a, shape, body)


def reorder(d: Dialect, a: str, shape: Sequence[int]) -> str:
    """Nodal values to the front of every axis, coefficients behind; the last axis first."""
    for axis in reversed(range(len(shape))):
        a = reorder_axis(d, a, shape, axis)
    return a


def unreorder(d: Dialect, a: str, shape: Sequence[int]) -> str:
    for axis in reversed(range(len(shape))):
        a = unreorder_axis(d, a, shape, axis)
    return a


def corner_steps(mask: tuple[bool, ...]) -> list[tuple[int, ...]]:
    """Corners of a coefficient's cell, in the order in which they are summed."""
    axes = [k for k, on in enumerate(mask) if on]
    #: Where axis 0 of three takes part, it varies fastest and axis 1 slowest.
    order = sorted(axes, key=[0, 2, 1].index, reverse=True) if len(mask) == 3 and mask[0] else axes
    corners = []
    for bits in product((0, 1), repeat=len(order)):
        step = [0] * len(mask)
        for axis, bit in zip(order, bits, strict=True):
            step[axis] = bit
        corners.append(tuple(step))
    return corners


def residual(d: Dialect, a: str, shape: Sequence[int], sign: str) -> str:
    """Each coefficient minus (sign -) or plus the mean of its cell's nodal corners, in a reordered box."""
    ms = [nodal(n) for n in shape]

    def body(x: str, p: str, c: list[str]) -> str:
        cases = []
        for mask in product((False, True), repeat=len(shape)):
            if not any(mask):
                continue
            when = " and ".join(f"{k} {'>=' if on else '<'} {m}" for k, on, m in zip(c, mask, ms, strict=True))
            corners = [d.at(x, index([f"{k} - {m} + {s}" if on else k for k, on, m, s in zip(c, mask, ms, step, strict=True)], shape)) for step in corner_steps(mask)]
            cases.append(f"when {when} then {d.at(x, p)} {sign} ({' + '.join(corners)}) / {d.number(float(len(corners)))}")
        return f"case {' '.join(cases)} else {d.at(x, p)} end"

    return over(d, a, shape, body)


def load_axis(d: Dialect, a: str, shape: Sequence[int], axis: int) -> str:
    """Load vector along an axis: n reordered values to m."""
    n, m = shape[axis], nodal(shape[axis])
    c_count = n - m
    out_shape = [m if k == axis else size for k, size in enumerate(shape)]
    twelfth, half = d.number(1.0 / 12), d.number(0.5)
    inner, ends = d.number(5.0 / 6), d.number(5.0 / 12)

    def body(x: str, p: str, c: list[str]) -> str:
        k = c[axis]
        value = lambda to: moved(d, x, c, shape, axis, to)
        first = f"{value('1')} * {twelfth} + {value(str(m))} * {half} + {value('0')} * {ends}"
        last = f"{value(str(c_count - 1))} * {twelfth} + {value(str(n - 1))} * {half} + {value(str(c_count))} * {ends}"
        mid = f"({value(f'{k} - 1')} + {value(f'{k} + 1')}) * {twelfth} + ({value(f'{m} + {k} - 1')} + {value(f'{m} + {k}')}) * {half} + {value(k)} * {inner}"
        ghost = f"when {k} = {m - 1} then {d.number(0.0)} " if n % 2 == 0 else ""
        return f"case {ghost}when {k} = 0 then {first} when {k} = {c_count} then {last} else {mid} end"

    return over(d, a, out_shape, body)


def solve_axis(d: Dialect, a: str, shape: Sequence[int], axis: int) -> str:
    """The mass matrix's inverse applied along an axis."""
    m, s = shape[axis], strides(shape)[axis]
    multipliers, pivots = thomas_factors(m)
    w, b, x, q, k, line, lines, p = (fresh(v) for v in ("w", "b", "a", "q", "k", "ln", "ls", "p"))
    picked = d.build(m, k, d.at(x, f"{d.div(q, s)} * {m * s} + {k} * {s} + {q} % {s}"))
    solved = d.let(line, picked, d.backward(d.forward(line, w), b, m))
    rows = d.build(math.prod(shape) // m, q, solved)
    back = d.build(math.prod(shape), p, d.at(d.at(lines, f"{d.div(p, m * s)} * {s} + {p} % {s}"), f"{d.div(p, s)} % {m}"))
    return d.let(w, d.numbers(multipliers), d.let(b, d.numbers(pivots), d.let(x, a, d.let(lines, rows, back))))


def correction(d: Dialect, a: str, shape: Sequence[int]) -> str:
    """L2 correction of the nodal corner from a box of residuals; the corner's own values do not enter."""
    ms = [nodal(n) for n in shape]
    out = over(d, a, shape, lambda x, p, c: f"case when {' and '.join(f'{k} < {m}' for k, m in zip(c, ms, strict=True))} then {d.number(0.0)} else {d.at(x, p)} end")
    shape = list(shape)
    for axis in reversed(range(len(shape))):
        out = load_axis(d, out, shape, axis)
        shape[axis] = ms[axis]
        out = solve_axis(d, out, shape, axis)
    return out


def apply_correction(d: Dialect, a: str, shape: Sequence[int], sign: str) -> str:
    ms, x, cor = [nodal(n) for n in shape], fresh("a"), fresh("r")
    body = over(d, x, shape, lambda y, p, c: f"case when {' and '.join(f'{k} < {m}' for k, m in zip(c, ms, strict=True))} then {d.at(y, p)} {sign} {d.at(cor, index(c, ms))} else {d.at(y, p)} end")
    return d.let(x, a, d.let(cor, correction(d, x, shape), body))


def decompose_level(d: Dialect, a: str, shape: Sequence[int], l2: bool) -> str:
    a = residual(d, reorder(d, a, shape), shape, "-")
    return apply_correction(d, a, shape, "+") if l2 else a


def recompose_level(d: Dialect, a: str, shape: Sequence[int], l2: bool) -> str:
    if l2:
        a = apply_correction(d, a, shape, "-")
    return unreorder(d, residual(d, a, shape, "+"), shape)


def box(d: Dialect, a: str, shape: Sequence[int], inner: Sequence[int], origin: Sequence[int] | None = None) -> str:
    """The box of an array that begins at origin, by default the leading one."""
    origin = origin or [0] * len(shape)
    return a if list(shape) == list(inner) else over(d, a, inner, lambda x, p, c: d.at(x, index([f"{k} + {o}" if o else k for k, o in zip(c, origin, strict=True)], shape)))


def put_box(d: Dialect, a: str, shape: Sequence[int], inner: Sequence[int], value: str, origin: Sequence[int] | None = None) -> str:
    """The array with that box replaced."""
    if list(shape) == list(inner):
        return value
    v, origin = fresh("v"), origin or [0] * len(shape)
    inside = lambda c: " and ".join(f"{k} >= {o} and {k} < {o + n}" if o else f"{k} < {n}" for k, n, o in zip(c, inner, origin, strict=True))
    at = lambda c: index([f"{k} - {o}" if o else k for k, o in zip(c, origin, strict=True)], inner)
    return d.let(v, value, over(d, a, shape, lambda x, p, c: f"case when {inside(c)} then {d.at(v, at(c))} else {d.at(x, p)} end"))


def decompose(d: Dialect, a: str, dims: Sequence[int], levels: int, l2: bool = True) -> str:
    """Exactly so many levels: the caller sees to what the dims allow."""
    for shape in reversed(level_dims(dims, levels)[1:]):
        x = fresh("g")
        a = d.let(x, a, put_box(d, x, dims, shape, decompose_level(d, box(d, x, dims, shape), shape, l2)))
    return a


def recompose(d: Dialect, a: str, dims: Sequence[int], levels: int, l2: bool = True, upto: int | None = None) -> str:
    """The inverse; with ``upto``, only the box of that level, from the coefficients up to it."""
    shapes = level_dims(dims, levels)
    upto = levels if upto is None else upto
    if upto < levels:
        a, dims = box(d, a, dims, shapes[upto]), shapes[upto]
    for shape in shapes[1 : upto + 1]:
        x = fresh("g")
        a = d.let(x, a, put_box(d, x, dims, shape, recompose_level(d, box(d, x, dims, shape), shape, l2)))
    return a


def restrict_axis(d: Dialect, a: str, shape: Sequence[int], axis: int, within: Sequence[int]) -> str:
    """Adds half of each neighbouring coefficient to the nodal values of an axis, where the other coordinates lie below ``within``."""
    n, m = shape[axis], nodal(shape[axis])
    c_count, half = n - m, d.number(2.0)

    def body(x: str, p: str, c: list[str]) -> str:
        k = c[axis]
        value = lambda to: moved(d, x, c, shape, axis, to)
        here = " and ".join(["true", *(f"{name} < {limit}" for j, (name, limit) in enumerate(zip(c, within, strict=True)) if j != axis)])
        own = d.at(x, p)
        return f"case when not ({here}) or {k} > {c_count} then {own} when {k} = 0 then {own} + {value(str(m))} / {half} when {k} = {c_count} then {own} + {value(str(n - 1))} / {half} else {own} + ({value(f'{m} + {k} - 1')} + {value(f'{m} + {k}')}) / {half} end"

    return over(d, a, shape, body)


def restriction(d: Dialect, a: str, shape: Sequence[int]) -> str:
    """Restriction of a reordered box: rows below the nodal limit of the axis before, then the other axes over nodal columns."""
    ms = [nodal(n) for n in shape]
    last = len(shape) - 1
    for axis in range(last, -1, -1):
        within = [ms[k] if k > axis or (axis == last and k == last - 1) else shape[k] for k in range(len(shape))]
        a = restrict_axis(d, a, shape, axis, within)
    return a


def dot(d: Dialect, a: str, b: str, size: int) -> str:
    """Products summed from the first point to the last."""
    x, y, p = fresh("a"), fresh("b"), fresh("p")
    return d.let(x, a, d.let(y, b, d.ordered_sum(d.build(size, p, f"{d.at(x, p)} * {d.at(y, p)}"))))


def level_of(d: Dialect, c: Sequence[str], shapes: Sequence[Sequence[int]]) -> str:
    """The least level whose box holds the coordinates."""
    inside = lambda shape: " and ".join(f"{k} < {n}" for k, n in zip(c, shape, strict=True))
    return "case " + " ".join(f"when {inside(shape)} then {k}" for k, shape in enumerate(shapes)) + " end"


def mask_of(d: Dialect, c: Sequence[str], shapes: Sequence[Sequence[int]]) -> str:
    """Bit per axis along which the point is a coefficient of its level."""
    inside = lambda shape: " and ".join(f"{k} < {n}" for k, n in zip(c, shape, strict=True))
    bits = lambda shape: " + ".join(f"case when {k} >= {n} then {1 << j} else 0 end" for j, (k, n) in enumerate(zip(c, shape, strict=True)))
    return f"case when {inside(shapes[0])} then 0 " + " ".join(f"when {inside(shape)} then {bits(shapes[k])}" for k, shape in enumerate(shapes[1:])) + " end"
