"""Blockwise predictor choice and coefficient coding inside one chunk, for the closed-loop array codec.

All functions take ``data`` as [chunks, cells] of one shape, so a batch of chunks advances together.
The relational view of the same fits and choices is in :mod:`errbound.operators.blocks`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from errbound.functions.quantizer import quantize_step
from errbound.operators.blocks import (POLY_BLOCK_CAP, coefficient_bounds, lorenzo_noise, monomials, normal_inverse)
from errbound.operators.closed_loop import lorenzo_terms, padded_index

LORENZO, REGRESSION, LORENZO2, POLY = 0, 1, 2, 3
COEFFICIENT_RADIUS = 32768


@dataclass
class Block:
    cells: np.ndarray
    shape: tuple[int, ...]
    basis: np.ndarray
    quadratic: np.ndarray | None
    sampled: np.ndarray


@lru_cache(maxsize=8)
def layout(shape: tuple[int, ...], edge: int, fast: bool, quadratic: bool) -> list[Block]:
    """Tiles of a chunk in raster order, with in-tile coordinates and sampled cells; slices of one shape share them."""
    grid = np.arange(int(np.prod(shape))).reshape(shape)
    blocks = []
    for corner in np.ndindex(*[-(-n // edge) for n in shape]):
        tile = grid[tuple(slice(c * edge, min((c + 1) * edge, n)) for c, n in zip(corner, shape))]
        local = np.stack([g.ravel() for g in np.indices(tile.shape)], 1).astype(np.float64)
        basis = np.column_stack([local, np.ones(len(local))])
        quad = None
        if quadratic and min(tile.shape) > 2:
            quad = np.stack([np.prod(local[:, :len(m)] ** np.array(m), axis=1) for m in monomials(len(shape))], 1)
        blocks.append(Block(tile.ravel(), tile.shape, basis, quad, _sampled(tile, fast)))
    return blocks


def _sampled(tile: np.ndarray, fast: bool) -> np.ndarray:
    """Flat cells visited by the predictor sampler, with repeats."""
    m, rank = min(tile.shape), tile.ndim
    if rank == 1:
        return tile.ravel()[[0, m - 1]]
    steps = np.arange(2, m - 1) if fast else np.arange(0, max(m - 2, 0))
    picks = []
    for flips in np.ndindex(*[2] * (rank - 1)):
        at = [steps] + [(m - steps if fast else m - 1 - steps) if f else steps for f in flips]
        picks.append(tile[tuple(at)])
    if fast and m > 3:
        picks.append(tile[(m - 1,) * rank].reshape(1))
    return np.concatenate(picks)


def linear_fit(values: np.ndarray, block: Block) -> np.ndarray:
    """Closed-form slopes and intercept [chunks, N+1]."""
    n, total = values.shape[1], values.sum(axis=1)
    out = np.zeros((len(values), len(block.shape) + 1))
    out[:, -1] = total / n
    for a, d in enumerate(block.shape):
        s = values @ block.basis[:, a]
        out[:, a] = (2 * s / (d - 1) - total) * 6 / n / (d + 1)
        out[:, -1] -= (d - 1) * out[:, a] / 2
    return out


def open_predictions(data: np.ndarray, shape: tuple[int, ...], layers: int, pred_dim: int | None) -> np.ndarray:
    """Lorenzo prediction of every cell from original neighbours."""
    where, big = padded_index(shape, 2)
    padded = np.zeros((len(data), int(np.prod(big))))
    padded[:, where] = data
    jump = [int(np.prod(big[a + 1:])) for a in range(len(big))]
    return sum(w * padded[:, where - sum(b * j for b, j in zip(back, jump))]
               for back, w in lorenzo_terms(len(shape), layers, pred_dim))


def choose(data: np.ndarray, shape: tuple[int, ...], blocks: list[Block], eb: np.ndarray,
           enabled: set[int], pred_dim: int | None) -> tuple[np.ndarray, list[dict[int, np.ndarray]]]:
    """Predictor per chunk and block, and the fitted coefficients.

    Errors are sampled on the block diagonals.  In 3-D without quadratic fits regression needs to beat
    the two-layer stencil strictly, elsewhere the first smallest error wins.
    """
    rank = len(shape)
    fast = rank == 3 and POLY not in enabled
    stencils = {k: open_predictions(data, shape, layers, pred_dim)
                for k, layers in ((LORENZO, 1), (LORENZO2, 2)) if k in enabled and not (rank == 4 and layers == 2)}
    noise_rank = pred_dim or rank
    sid = np.zeros((len(data), len(blocks)), np.int32)
    fits: list[dict[int, np.ndarray]] = []
    for k, block in enumerate(blocks):
        values, errors, fitted = data[:, block.cells], {}, {}
        at = block.sampled
        for kind, pred in stencils.items():
            noise = lorenzo_noise(noise_rank, 1 if kind == LORENZO else 2) * eb
            errors[kind] = (np.abs(data[:, at] - pred[:, at]) + noise[:, None]).sum(axis=1)
        position = np.searchsorted(block.cells, at)
        if REGRESSION in enabled and min(block.shape) > 1:
            fitted[REGRESSION] = linear_fit(values, block)
            errors[REGRESSION] = np.abs(values - fitted[REGRESSION] @ block.basis.T)[:, position].sum(axis=1)
        if POLY in enabled and block.quadratic is not None:
            fitted[POLY] = values @ block.quadratic @ normal_inverse(block.shape).T
            errors[POLY] = np.abs(values - fitted[POLY] @ block.quadratic.T)[:, position].sum(axis=1)
        sid[:, k] = _fast_rule(errors, len(data)) if fast else _first_smallest(errors, len(data))
        fits.append(fitted)
    return sid, fits


def _first_smallest(errors: dict[int, np.ndarray], n: int) -> np.ndarray:
    order = [k for k in (LORENZO, LORENZO2, REGRESSION, POLY) if k in errors]
    if not order:
        return np.full(n, LORENZO, np.int32)
    return np.array(order, np.int32)[np.argmin(np.stack([errors[k] for k in order]), axis=0)]


def _fast_rule(errors: dict[int, np.ndarray], n: int) -> np.ndarray:
    inf = np.full(n, np.inf)
    lor, lor2, reg = (errors.get(k, inf) for k in (LORENZO, LORENZO2, REGRESSION))
    use_reg = (REGRESSION in errors) & (reg <= lor) & ((reg < lor2) | (LORENZO2 not in errors))
    use_two = (LORENZO2 in errors) & (lor2 <= lor) & (lor2 <= reg)
    return np.where(use_reg, REGRESSION, np.where(use_two, LORENZO2, LORENZO)).astype(np.int32)


def coefficient_ebs(kind: int, rank: int, eb: np.ndarray, edge: int) -> np.ndarray:
    """Bound per coefficient [chunks, coefficients]."""
    if kind == REGRESSION:
        b = coefficient_bounds("fast3d" if rank == 3 else "linear", rank, 1.0, edge)
        row = [b["slope"]] * rank + [b["intercept"]]
    else:
        b = coefficient_bounds("poly", rank, 1.0, edge)
        degree = [sum(m) for m in monomials(rank)]
        row = [(b["intercept"], b["slope"], b["square"])[d] for d in degree]
    return np.asarray(eb, np.float64)[:, None] * np.array(row)


def code_coefficients(sid: np.ndarray, fits: list[dict[int, np.ndarray]], rank: int, eb: np.ndarray, edge: int):
    """Quantize each committed block's coefficients against the previous committed ones.

    Returns indices [chunks, blocks, width] per kind and the reconstructed coefficients.
    """
    coded, rebuilt = {}, {}
    for kind in (REGRESSION, POLY):
        if not any(kind in f for f in fits):
            continue
        ebs = coefficient_ebs(kind, rank, eb, edge)
        width = ebs.shape[1]
        q = np.zeros((len(sid), len(fits), width), np.int32)
        value = np.zeros((len(sid), len(fits), width))
        prev = np.zeros((len(sid), width))
        for k, fit in enumerate(fits):
            if kind not in fit:
                continue
            used = sid[:, k] == kind
            qk, vk = quantize_step(fit[kind], prev, ebs, COEFFICIENT_RADIUS)
            q[:, k], value[:, k] = qk, vk
            prev = np.where(used[:, None], vk, prev)
        coded[kind], rebuilt[kind] = q, value
    return coded, rebuilt


def forced_predictions(sid: np.ndarray, rebuilt: dict[int, np.ndarray], blocks: list[Block], cells: int):
    """Predictions of regression blocks (NaN elsewhere) and the mask of two-layer blocks."""
    forced = np.full((len(sid), cells), np.nan)
    second = np.zeros((len(sid), cells), bool)
    for k, block in enumerate(blocks):
        for kind, basis in ((REGRESSION, block.basis), (POLY, block.quadratic)):
            rows = np.flatnonzero(sid[:, k] == kind)
            if len(rows) and kind in rebuilt:
                forced[np.ix_(rows, block.cells)] = rebuilt[kind][rows, k] @ basis.T
        rows = np.flatnonzero(sid[:, k] == LORENZO2)
        second[np.ix_(rows, block.cells)] = True
    return forced, second


def effective_edge(rank: int, edge: int, quadratic: bool) -> int:
    return min(edge, POLY_BLOCK_CAP[min(rank, 3)]) if quadratic else edge
