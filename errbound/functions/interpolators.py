"""Interpolation stencils; each works on Columns and on NumPy arrays alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


# The weights of the stencils from here to cubic2 are those of the inventory.

def linear(a, b):
    return (a + b) / 2


def linear1(a, b):
    return -0.5 * a + 1.5 * b


def quad_1(a, b, c):
    return (3 * a + 6 * b - c) / 8


def quad_2(a, b, c):
    return (-a + 6 * b + 3 * c) / 8


def quad_3(a, b, c):
    return (3 * a - 10 * b + 15 * c) / 8


def cubic(a, b, c, d):
    return (-a + 9 * b + 9 * c - d) / 16


def cubic_front(a, b, c, d):
    return (5 * a + 15 * b - 5 * c + d) / 16


def cubic_front_2(a, b, c, d):
    return (a + 6 * b - 4 * c + d) / 4


def cubic_back_1(a, b, c, d):
    return (a - 5 * b + 15 * c + 5 * d) / 16


def cubic_back_2(a, b, c, d):
    return (-5 * a + 21 * b - 35 * c + 35 * d) / 16


def cubic2(a, b, c, d):
    return (-3 * a + 23 * b + 23 * c - 3 * d) / 40


def _abs(x):
    return F.abs(x) if isinstance(x, Column) else np.abs(x)


def _where(cond, a, b):
    if isinstance(cond, Column):
        return F.when(cond, a).otherwise(b)
    return np.where(cond, a, b)


def akima(a, b, c, d):
    left, right = 2 * b - a - c, 2 * c - b - d
    wl, wr = _abs(left), _abs(right)
    total = wl + wr
    safe = _where(total > 1e-9, total, 1.0)
    return linear(b, c) + _where(total > 1e-9, (left * wr + right * wl) / 8 / safe, 0.0)


def _harmonic(p, q, whole):
    safe = _where(_abs(whole) > 1e-9, whole, 1.0)
    rising = (p < 0) == (q < 0)
    return _where(rising & (_abs(whole) > 1e-9), p * q / safe, 0.0)


def pchip(a, b, c, d, weight: float = 0.0):
    """Monotone cubic; the customary weight is 0.25, the compatible default 0 reduces it to linear."""
    return (linear(b, c) + weight * _harmonic(b - a, c - b, c - a)
            - weight * _harmonic(c - b, d - c, d - b))
