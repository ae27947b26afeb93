"""Closed loops against scalar re-statements of the recurrence."""

import itertools
import math

import numpy as np
import pytest

from errbound.functions.quantizer import quantize_step
from errbound.operators import closed_loop as cl
from errbound.operators import interp
from errbound.operators.levels import cluster_centres, regular_levels


def scalar_quantize(v, p, eb, radius):
    d = v - p
    if not abs(d) / eb < 2 * radius:
        return 0, v
    k = int(abs(d) * (1 / eb)) + 1
    if k >= 2 * radius:
        return 0, v
    h = k >> 1
    s = -h if d < 0 else h
    r = p + 2 * s * eb
    return (0, v) if abs(r - v) > eb else (radius + s, r)


@pytest.mark.parametrize("eb,radius", [(1.0, 32768), (1.0, 16), (0.003, 64), (0.1, 32768), (1e-9, 8)])
def test_quantizer(eb, radius):
    rng = np.random.default_rng(0)
    v, p = np.round(rng.normal(0, 50, 2000), 2), np.round(rng.normal(0, 50, 2000), 2)
    q, r = quantize_step(v, p, eb, radius)
    want = [scalar_quantize(a, b, eb, radius) for a, b in zip(v, p)]
    assert q.tolist() == [w[0] for w in want]
    np.testing.assert_allclose(r, [w[1] for w in want])


def test_wild_values_are_unpredictable():
    v = np.array([np.nan, np.inf, -np.inf, 1e300])
    q, r = quantize_step(v, np.zeros(4), 0.1, 32768)
    assert (q == 0).all() and r[1] == math.inf and math.isnan(r[0])


@pytest.mark.parametrize("shape,layers,pred_dim", [((50,), 1, None), ((7, 9), 1, None), ((7, 9), 2, None),
                                                   ((4, 5, 6), 1, None), ((4, 5, 6), 2, None), ((4, 5, 6), 1, 2),
                                                   ((3, 4, 3, 4), 1, None), ((5, 1, 4), 1, None)])
def test_lorenzo_nd(shape, layers, pred_dim):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(3, int(np.prod(shape)))).cumsum(axis=1)
    eb = np.array([0.05, 0.5, 1e-4])
    q, recon = cl.lorenzo_nd_step(data, shape, eb, 128, layers, pred_dim)
    assert (np.abs(recon - data) <= eb[:, None] * (1 + 1e-12)).all()
    stored = np.where(q == 0, data, 0.0)
    back = cl.lorenzo_nd_recover(q, stored, shape, eb, 128, layers, pred_dim)
    np.testing.assert_array_equal(back, recon)
    # Raster-order scalar loop gives the same indices.
    weights = cl.lorenzo_terms(len(shape), layers, pred_dim)
    for c in range(3):
        rec, got = np.zeros(shape), q[c].reshape(shape)
        for at in itertools.product(*map(range, shape)):
            p = sum(w * rec[tuple(a - b for a, b in zip(at, back))] for back, w in weights
                    if all(a >= b for a, b in zip(at, back)))
            idx, rec[at] = scalar_quantize(data[c].reshape(shape)[at], p, eb[c], 128)
            assert idx == got[at]


def test_stencil_terms():
    assert sorted(w for _, w in cl.lorenzo_terms(2, 1)) == [-1, 1, 1]
    assert [len(cl.lorenzo_terms(n, 1)) for n in (1, 2, 3, 4)] == [1, 3, 7, 15]
    assert [len(cl.lorenzo_terms(n, 2)) for n in (1, 2, 3)] == [2, 8, 26]
    assert len(cl.lorenzo_terms(4, 2)) == 15


@pytest.mark.parametrize("shape", [(1,), (2,), (5,), (33,), (64,), (9, 14), (1, 7), (20, 30, 12), (3, 5, 4, 6)])
@pytest.mark.parametrize("kind", ["linear", "cubic"])
@pytest.mark.parametrize("block", [None, 32, 4])
def test_interpolation_sweep(shape, kind, block):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(2, int(np.prod(shape)))).cumsum(axis=1)
    eb = np.array([0.01, 0.3])
    for direction in {0, math.factorial(len(shape)) - 1}:
        cells = [0] + [c for _, at, _, _ in interp.passes(shape, kind, direction, block) for c in at]
        assert sorted(cells) == list(range(data.shape[1])), "every cell is predicted exactly once"
        q, recon = interp.sweep(data, shape, eb, 32768, kind, direction, block)
        assert (np.abs(recon - data) <= eb[:, None] * (1 + 1e-12)).all()
        back = interp.unsweep(q, np.where(q == 0, data, 0.0), shape, eb, 32768, kind, direction, block)
        np.testing.assert_array_equal(back, recon)


def brute_cost(x, k):
    """Best k-means cost by trying every split of the sorted values."""
    best = math.inf
    for cuts in itertools.combinations(range(1, len(x)), k - 1):
        parts = np.split(x, cuts)
        best = min(best, sum(((p - p.mean()) ** 2).sum() for p in parts))
    return best


def test_kmeans_levels():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.01, 60) for c in (1.0, 2.0, 3.0, 4.0)])
    centres = cluster_centres(x)
    np.testing.assert_allclose(centres, [1, 2, 3, 4], atol=0.02)
    start, offset, count = regular_levels(centres, x.max())
    assert abs(start - 1) < 0.02 and abs(offset - 1) < 0.02 and count == 4
    assert len(cluster_centres(rng.random(400))) in range(0, 400)


def test_kmeans_row_is_optimal():
    from errbound.operators.levels import _costs, _next_row
    x = np.sort(np.random.default_rng(6).normal(size=11))
    cum = np.stack([np.append(0.0, np.cumsum(x)), np.append(0.0, np.cumsum(x * x))])
    row = _costs(cum, np.zeros(11, np.int64), np.arange(11))
    for k in (2, 3, 4):
        row, _ = _next_row(row, cum)
        assert abs(row[-1] - brute_cost(x, k)) < 1e-9
