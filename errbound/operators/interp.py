"""Multi-level interpolation prediction.

A level predicts the odd points of a lattice from its even points.  :func:`level_residuals` is the
open-loop view of one level.  :func:`sweep` is the closed loop: inside a level
all points of one axis pass are independent, so each pass is one vectorised step over all lines of all
chunks of equal shape.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from errbound.functions import interpolators as ip
from errbound.functions.quantizer import quantize_step
from errbound.operators.closed_loop import _ragged

# Fixed value: the bound is halved on the coarse levels (3 and above).
COARSE_RATIO = 0.5
COARSE_FROM = 3


def level_residuals(values: str, kind: str) -> Column:
    """Array of (i, residual) for the odd positions of the finest level, from original neighbours."""
    @F.arrow_udf("array<struct<i: bigint, residual: double>>")
    def run(vals: pa.Array) -> pa.Array:
        flat, offsets = _ragged(vals)
        lengths = np.diff(offsets)
        counts = lengths // 2
        ends = np.concatenate([[0], np.cumsum(counts)])
        where, residual = np.zeros(ends[-1], np.int64), np.zeros(ends[-1])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            line = flat[offsets[rows][:, None] + np.arange(n)]
            for at, (stencil, near) in _line_predictions(int(n), kind):
                slot = ends[rows][:, None] + at // 2
                where[slot] = at
                residual[slot] = line[:, at] - stencil(*[line[:, at + o] for o in near])
        pairs = pa.StructArray.from_arrays([pa.array(where), pa.array(residual)], ["i", "residual"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)

    return run(values)


def _line_predictions(n: int, kind: str) -> list[tuple[np.ndarray, tuple]]:
    """Which stencil predicts which odd positions of a line of ``n`` lattice points."""
    if n < 2:
        return []
    odd = np.arange(1, n, 2)
    if kind == "linear" or n < 5:
        mid = odd[odd + 1 < n]
        plan = [(mid, (ip.linear, (-1, 1)))]
        if n % 2 == 0:
            plan.append((np.array([n - 1]), (lambda a: a, (-1,)) if n < 4 else (ip.linear1, (-3, -1))))
        return [(at, how) for at, how in plan if len(at)]
    mid = odd[(odd >= 3) & (odd + 3 < n)]
    last = n - 3 if n % 2 == 0 else n - 2
    plan = [(mid, (ip.cubic, (-3, -1, 1, 3))), (np.array([1]), (ip.quad_1, (-1, 1, 3)))]
    if last > 1:
        plan.append((np.array([last]), (ip.quad_2, (-3, -1, 1))))
    if n % 2 == 0:
        plan.append((np.array([n - 1]), (ip.quad_3, (-5, -3, -1))))
    return [(at, how) for at, how in plan if len(at)]


def passes(shape: tuple[int, ...], kind: str, direction: int, block: int | None = None):
    """Yield (level, cells, stencil, neighbour cells) of a whole sweep in dependency order.

    ``direction`` numbers the lexicographic axis permutations.  With ``block`` the lines restart at
    block edges of ``block * stride`` points, as the tiled sweep does.
    """
    grid = np.arange(int(np.prod(shape))).reshape(shape)
    top = max(int(np.ceil(np.log2(s))) if s > 1 else 0 for s in shape)
    order = list(permutations(range(len(shape))))[direction]
    for level in range(top, 0, -1):
        stride = 1 << (level - 1)
        for turn, axis in enumerate(order):
            # Axes already swept at this level lie on the fine lattice, the later ones on the coarse.
            pick = []
            for a in range(len(shape)):
                fine = order.index(a) <= turn
                pick.append(slice(None, None, stride if fine else 2 * stride))
            lattice = np.moveaxis(grid[tuple(pick)], axis, -1)
            n = lattice.shape[-1]
            span = n if block is None else block
            for start in range(0, max(n - 1, 1), span):
                line = lattice[..., start:start + span + 1] if block is not None else lattice
                for at, (stencil, offsets) in _line_predictions(line.shape[-1], kind):
                    yield level, line[..., at].ravel(), stencil, [line[..., at + o].ravel() for o in offsets]


def sweep(data: np.ndarray, shape: tuple[int, ...], eb: np.ndarray, radius: int, kind: str = "cubic",
          direction: int = 0, block: int | None = 32):
    """Closed-loop interpolation of ``data`` [chunks, cells]: indices and reconstructions, by cell."""
    q, recon = np.zeros(data.shape, np.int32), data.copy()
    bound = np.asarray(eb, np.float64).reshape(-1, 1)
    q[:, 0], recon[:, 0] = quantize_step(data[:, 0], np.zeros(len(data)), bound[:, 0], radius)
    for level, cells, stencil, near in passes(shape, kind, direction, block):
        b = bound * (COARSE_RATIO if level >= COARSE_FROM else 1.0)
        pred = stencil(*[recon[:, c] for c in near])
        q[:, cells], recon[:, cells] = quantize_step(data[:, cells], pred, b, radius)
    return q, recon


def unsweep(q: np.ndarray, stored: np.ndarray, shape: tuple[int, ...], eb: np.ndarray, radius: int,
            kind: str = "cubic", direction: int = 0, block: int | None = 32) -> np.ndarray:
    recon = np.zeros(q.shape)
    bound = np.asarray(eb, np.float64).reshape(-1, 1)
    recon[:, :1] = np.where(q[:, :1] == 0, stored[:, :1], 2 * (q[:, :1] - radius) * bound)
    for level, cells, stencil, near in passes(shape, kind, direction, block):
        b = bound * (COARSE_RATIO if level >= COARSE_FROM else 1.0)
        pred = stencil(*[recon[:, c] for c in near])
        idx = q[:, cells]
        recon[:, cells] = np.where(idx == 0, stored[:, cells], pred + 2 * (idx - radius) * b)
    return recon
