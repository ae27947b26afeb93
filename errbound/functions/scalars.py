"""Scalar helpers: bound resolution formulas, bit widths, zig-zag, byte views."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: share of values assumed inside the quantization range by the PSNR bound.
PSNR_THRESHOLD = 0.99


def psnr_bound(psnr: float, value_range) -> Column:
    exponent = (psnr + 10 * math.log10(1 - 2.0 / 3.0 * PSNR_THRESHOLD)) / -20.0
    return F.lit(math.pow(10.0, exponent)) * value_range


def l2norm_bound(norm: float, n) -> Column:
    return F.sqrt(F.lit(3.0) / n) * F.lit(float(norm))


def next_pow2(x: int) -> int:
    return 1 << max(0, int(x) - 1).bit_length()


def next_pow2_col(x: Column) -> Column:
    """Smallest power of two that is at least ``x``, from the binary digits of x-1."""
    return F.when(x <= 1, F.lit(1)).otherwise(
        F.pow(F.lit(2.0), F.length(F.bin((x - 1).cast("bigint")))).cast("bigint"))


def fixed_width(span: Column) -> Column:
    """Bits per symbol of fixed-length coding over ``span`` distinct offsets, at least one."""
    return F.when(span <= 2, F.lit(1)).otherwise(F.length(F.bin((span - 1).cast("bigint")))).cast("int")


def zigzag(symbol: Column, states: int) -> Column:
    """Fold a symbol around the centre of its range: centre 0, below odd, above even."""
    off = symbol - states // 2
    return F.when(off < 0, -2 * off - 1).otherwise(2 * off)


def unzigzag(code: Column, states: int) -> Column:
    return F.when(code % 2 == 1, F.lit(states // 2) - F.shiftright(code + 1, 1)).otherwise(
        F.lit(states // 2) + F.shiftright(code, 1))


def float_bits(value: str | Column) -> Column:
    """Bit pattern of the value as a 32-bit float."""
    @F.pandas_udf("int")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy(np.float32).view(np.int32))

    return run(value)


def bits_float(bits: str | Column) -> Column:
    @F.pandas_udf("float")
    def run(b: pd.Series) -> pd.Series:
        return pd.Series(b.to_numpy(np.int32).view(np.float32))

    return run(bits)


def truncate_bits(bits: Column, keep_bytes: int) -> Column:
    """Keep the ``keep_bytes`` most significant bytes of a 32-bit pattern."""
    mask = (0xFFFFFFFF << (8 * (4 - keep_bytes))) & 0xFFFFFFFF
    return bits.bitwiseAND(F.lit(mask - (1 << 32) if mask >= 1 << 31 else mask))


def changed_low_bytes(previous_bits: Column, bits: Column) -> Column:
    """How many low bytes differ from the previous pattern (0-4)."""
    x = previous_bits.bitwiseXOR(bits)
    return (F.when(x == 0, 0).when(F.shiftrightunsigned(x, 8) == 0, 1)
            .when(F.shiftrightunsigned(x, 16) == 0, 2).when(F.shiftrightunsigned(x, 24) == 0, 3)
            .otherwise(4))
