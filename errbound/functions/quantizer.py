"""Linear-scale quantization as Column expressions and as a NumPy step for ordered folds.

Index 0 marks an unpredictable value; radius +/- h marks a shift of 2*h error bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_RADIUS = 32768


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def quantize(value, predicted, eb, radius: int = DEFAULT_RADIUS) -> Column:
    """Quantization index of ``value`` against ``predicted``; NaN and infinities give 0."""
    v, p = _col(value), _col(predicted)
    half, shift = _half_steps(v, p, eb)
    ok = _predictable(v, p, eb, radius)
    return F.when(ok, F.lit(radius) + F.when(v < p, -half).otherwise(half)).otherwise(0).cast("int")


def _half_steps(v: Column, p: Column, eb) -> tuple[Column, Column]:
    # The cap keeps floor() inside BIGINT for huge and NaN differences; both are unpredictable.
    steps = F.floor(F.least(F.abs(v - p) * _reciprocal(eb), F.lit(4e9))) + 1
    half = F.shiftright(steps, 1)
    return half, F.when(v < p, -2 * half).otherwise(2 * half)


def _reciprocal(eb) -> Column:
    return F.lit(1.0 / eb) if isinstance(eb, (int, float)) else F.lit(1.0) / _col(eb)


def _predictable(v: Column, p: Column, eb, radius: int) -> Column:
    steps = F.floor(F.least(F.abs(v - p) * _reciprocal(eb), F.lit(4e9))) + 1
    _, shift = _half_steps(v, p, eb)
    rebuilt = p + shift.cast("double") * _col(eb)
    return (steps < 2 * radius) & (F.abs(rebuilt - v) <= _col(eb))


def requantized(value, predicted, eb, radius: int = DEFAULT_RADIUS) -> Column:
    """The reconstruction the quantizer would leave behind: snapped, or the value itself."""
    v, p = _col(value), _col(predicted)
    _, shift = _half_steps(v, p, eb)
    return F.when(_predictable(v, p, eb, radius), p + shift.cast("double") * _col(eb)).otherwise(v)


def recover(index, predicted, eb, unpredictable, radius: int = DEFAULT_RADIUS) -> Column:
    """Inverse of :func:`quantize`; index 0 takes the stored value."""
    q = _col(index)
    return F.when(q == 0, _col(unpredictable)).otherwise(
        _col(predicted) + (2 * (q - radius)).cast("double") * _col(eb))


def grid_index(value, origin, eb) -> Column:
    """Cell of a uniform grid of cell width 2*eb that starts at ``origin``."""
    return F.shiftright(F.floor((_col(value) - _col(origin)) / _col(eb)), 1)


def grid_centre(index, origin, eb) -> Column:
    return (2 * _col(index) + 1).cast("double") * _col(eb) + _col(origin)


def quantize_step(value: np.ndarray, predicted: np.ndarray, eb, radius: int):
    """One vectorised closed-loop step: indices and the reconstruction that the next step sees."""
    diff = value - predicted
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(diff) * (1.0 / eb)
        wild = ~(scaled < 2.0 * radius)
        steps = np.where(wild, 2 * radius, scaled).astype(np.int64) + 1
        half = steps >> 1
        signed = np.where(diff < 0, -half, half)
        rebuilt = predicted + (2 * signed) * eb
        ok = (steps < 2 * radius) & (np.abs(rebuilt - value) <= eb)
    return (np.where(ok, radius + signed, 0).astype(np.int32), np.where(ok, rebuilt, value))
