"""Numpy kernels against the definitions: goldens, inverse, projection, linearity."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions.levels import depth, level_dims, nodal
from gridloom.operators import kernels

grids = st.lists(st.integers(3, 20), min_size=1, max_size=3)


@pytest.mark.parametrize(("given_", "l2", "out"), [([1, 4, 2], False, [1, 2, 2.5]), ([1, 4, 2, 5], False, [1, 2, 8, 2.5]), ([1, 4, 2], True, [2.25, 3.25, 2.5])])
def test_goldens(given_, l2, out):
    np.testing.assert_allclose(kernels.decompose(np.array([given_], float), 1, l2)[0], out, atol=1e-14)


@settings(max_examples=60, deadline=None)
@given(grids, st.booleans(), st.integers(0, 9))
def test_round_trip(dims, l2, seed):
    x = np.random.default_rng(seed).standard_normal((2, *dims))
    for levels in (None, 1):
        back = kernels.recompose(kernels.decompose(x, levels, l2), levels, l2)
        np.testing.assert_allclose(back, x, atol=1e-10)


@settings(max_examples=30, deadline=None)
@given(grids, st.booleans())
def test_constants_have_no_coefficients(dims, l2):
    y = kernels.decompose(np.full((1, *dims), 3.0), 1, l2)
    np.testing.assert_allclose(y[(0, *(slice(0, nodal(n)) for n in dims))], 3.0, atol=1e-12)
    y[(0, *(slice(0, nodal(n)) for n in dims))] = 0
    np.testing.assert_allclose(y, 0, atol=1e-12)


@pytest.mark.parametrize("n", [3, 5, 9, 17])
def test_odd_lines_are_projected(n):
    """Coarse values are the least-squares projection onto piecewise linear functions of the coarse nodes."""
    m = nodal(n)
    fine = np.zeros((n, n))
    for k in range(n - 1):
        fine[k : k + 2, k : k + 2] += np.array([[2, 1], [1, 2]]) / 6
    up = np.array([np.interp(np.arange(n), np.arange(0, n, 2), e) for e in np.eye(m)]).T
    x = np.random.default_rng(n).standard_normal(n)
    best = np.linalg.solve(up.T @ fine @ up, up.T @ fine @ x)
    np.testing.assert_allclose(kernels.decompose(x[None], 1, True)[0, :m], best, atol=1e-12)


def test_linearity():
    a, b = np.random.default_rng(1).standard_normal((2, 1, 7, 8, 5))
    np.testing.assert_allclose(kernels.decompose(2 * a + b, None, True), 2 * kernels.decompose(a, None, True) + kernels.decompose(b, None, True), atol=1e-11)


#: Levels by the shortest axis, written out by hand.
LEVELS = {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2, 8: 3, 9: 3, 10: 3, 11: 3, 12: 3, 13: 3, 14: 3, 15: 3, 16: 4, 17: 4, 18: 4, 19: 4, 20: 4, 63: 5, 64: 6}


@pytest.mark.parametrize(("n", "levels"), LEVELS.items())
def test_depth_by_hand(n, levels):
    assert depth((n,)) == depth((n, 70)) == depth((80, n, 90)) == levels
    assert depth((n,), 1) == min(1, levels)
    assert all(m > 2 for shape in level_dims((n,), levels)[1:] for m in shape)


def test_six_points_by_hand():
    """Two levels: 6 to 4 to 3 values."""
    y = kernels.decompose(np.array([[1, 4, 2, 5, 3, 7.0]]), None, True)[0]
    np.testing.assert_allclose(y[:3], [2.48, 3.79, 17.60], atol=0.01)
    np.testing.assert_allclose(kernels.recompose(y[None], None, True)[0], [1, 4, 2, 5, 3, 7], atol=1e-12)


@pytest.mark.parametrize("shape", [(9,), (6, 7), (5, 4, 6)])
def test_restriction(shape):
    """Along each axis: a node gains half of the coefficients beside it; of the last axis, only in nodal rows of the axis before."""
    x = np.random.default_rng(8).standard_normal((2, *shape))
    want, last = x.copy(), len(shape) - 1
    for axis in range(last, -1, -1):
        within = [nodal(n) if k > axis or (axis == last and k == last - 1) else n for k, n in enumerate(shape)]
        m, before = nodal(shape[axis]), want.copy()
        for at in np.ndindex(2, *shape):
            k, at_ = at[axis + 1], list(at)
            if k <= shape[axis] - m and all(at[j + 1] < n for j, n in enumerate(within) if j != axis):
                for c in (k - 1, k):
                    if 0 <= c < shape[axis] - m:
                        at_[axis + 1] = m + c
                        want[at] += before[tuple(at_)] / 2
    np.testing.assert_allclose(kernels.restriction(x), want, atol=1e-14)


def test_levels():
    assert [s[0] for s in level_dims((64,), 6)][::-1] == [64, 33, 17, 9, 5, 3, 2]
    assert (depth((64,)), depth((8, 8)), depth((2,)), depth((1, 9)), depth((3, 9), 5)) == (6, 3, 0, 0, 1)
    with pytest.raises(ValueError, match="axes"):
        depth((2, 2, 2, 2))


def test_single_precision_stays_single():
    assert kernels.decompose(np.ones((1, 9), np.float32), None, True).dtype == np.float32
