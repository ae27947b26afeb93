"""Per-value transforms: range filter, transpose, axis unpivot, log transform, byte truncation, wavelet."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errbound.config import strides
from errbound.functions import scalars
from errbound.operators.closed_loop import _ragged


def replace_outside(value: str, low: float, high: float, default: float) -> Column:
    v = F.col(value)
    return F.when(v.between(low, high), v).otherwise(F.lit(default))


def transpose(df: DataFrame, dims: list[int], axes: list[int], idx: str = "idx", out: str = "idx") -> DataFrame:
    """Renumber row-major positions for permuted axes; a projection, no data movement."""
    steps = strides(dims)
    coords = [F.floor(F.col(idx) / steps[a]) % dims[a] for a in range(len(dims))]
    target = strides([dims[a] for a in axes])
    position = sum((coords[a] * target[k] for k, a in enumerate(axes)), F.lit(0))
    return df.withColumn(out, position.cast("bigint"))


def unpivot_axes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Interleaved x, y, z columns to one row per axis."""
    return df.unpivot(keys, ["x", "y", "z"], "axis", "v")


def pivot_axes(df: DataFrame, keys: list[str]) -> DataFrame:
    axis = F.col("axis")
    return df.groupBy(*keys).agg(*[F.max(F.when(axis == a, F.col("v"))).alias(a) for a in "xyz"])


def log_transform(df: DataFrame, value: str, rel: float) -> DataFrame:
    """Map a point-wise relative bound to an absolute one on ``log2|v|``.

    Adds ``log_v``, ``sign_v``, ``min_log`` and ``log_eb``.  The two extremes are one aggregated row.
    """
    v = F.col(value)
    logged = F.when(v != 0, F.log2(F.abs(v)))
    # 1.2e-7 guards float rounding of the log; 2.0001 and 1.0001 place zero below it.
    facts = df.agg(F.min(logged).alias("min_log"), F.max(logged).alias("_max")).select(
        "min_log", (F.lit(math.log2(1 + rel)) - F.greatest("_max", F.abs("min_log")) * 1.2e-7).alias("log_eb"))
    both = df.crossJoin(F.broadcast(facts))
    return both.withColumn("sign_v", F.when(v < 0, -1).otherwise(1)).withColumn(
        "log_v", F.coalesce(logged, F.col("min_log") - F.lit(2.0001) * F.col("log_eb")))


def log_inverse(decoded: str, sign: str, min_log: str, log_eb: str) -> Column:
    d = F.col(decoded)
    return F.when(d < F.col(min_log) - F.lit(1.0001) * F.col(log_eb), F.lit(0.0)).otherwise(
        F.col(sign) * F.pow(F.lit(2.0), d))


def truncate_mantissa(value: str, keep_bytes: int) -> Column:
    return scalars.bits_float(scalars.truncate_bits(scalars.float_bits(value), keep_bytes))


def low_bytes(bits: Column, count: Column) -> Column:
    """The ``count`` low bytes of a 32-bit pattern, as an unsigned number."""
    whole = bits.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return whole % F.pow(F.lit(256.0), count).cast("bigint")


def restore_low_bytes(previous: Column, kept: Column, count: Column) -> Column:
    """Overlay the kept low bytes on the previous pattern."""
    whole = previous.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    unit = F.pow(F.lit(256.0), count).cast("bigint")
    merged = whole - whole % unit + kept
    return F.when(merged >= 1 << 31, merged - (1 << 32)).otherwise(merged).cast("int")


# Four-tap Daubechies scaling filter, (1±√3)/(4√2) and (3±√3)/(4√2).
_R3, _D = math.sqrt(3.0), 4 * math.sqrt(2.0)
SCALING = np.array([(1 + _R3) / _D, (3 + _R3) / _D, (3 - _R3) / _D, (1 - _R3) / _D])
WAVELET = np.array([SCALING[3], -SCALING[2], SCALING[1], -SCALING[0]])


def wavelet(values: str | Column, inverse: bool = False) -> Column:
    """Daubechies-4 transform of each array, zero-padded to a power of two (pads are kept)."""
    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        flat, off = _ragged(col)
        pieces = []
        for a, b in zip(off[:-1], off[1:]):
            x = np.zeros(scalars.next_pow2(b - a))
            x[:b - a] = flat[a:b]
            sizes = [len(x) >> s for s in range(len(x).bit_length() - 1)]
            for n in (reversed(sizes) if inverse else sizes):
                step = _analysis(x[:n]) if not inverse else _synthesis(x[:n])
                x[:n] = step
            pieces.append(x)
        off2 = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off2), pa.array(np.concatenate(pieces) if pieces else np.zeros(0)))

    return run(values)


def _analysis(x: np.ndarray) -> np.ndarray:
    at = (2 * np.arange(len(x) // 2)[:, None] + np.arange(4)) % len(x)
    return np.concatenate([x[at] @ SCALING, x[at] @ WAVELET])


def _synthesis(y: np.ndarray) -> np.ndarray:
    half = len(y) // 2
    at = (2 * np.arange(half)[:, None] + np.arange(4)) % len(y)
    out = np.zeros(len(y))
    np.add.at(out, at, y[:half, None] * SCALING + y[half:, None] * WAVELET)
    return out
