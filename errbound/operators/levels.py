"""Discrete-level prediction: values near a few regular levels are coded as level numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errbound.functions import quantizer as qz
from errbound.operators.ordering import ordered_prefix, with_neighbours

# Fixed values of level detection and coding.
MAX_LEVELS = 150
STOP_RATIO = 1.5
LEVEL_BIAS = 200
MAX_LEVEL_SHARE = 0.25
# Slices of a key's range in which values are summed before levels are fitted.
LEVEL_BINS = 1 << 14


def level_number(value: str | Column, start, offset) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.round((v - start) / offset).cast("bigint")


def level_value(level: Column, start, offset) -> Column:
    return start + level.cast("double") * offset


def vq(df: DataFrame, keys: list[str], pos: str, value: str, start, offset, levels, eb, radius: int) -> DataFrame:
    """Level numbers along ``pos``: stored delta (biased), quantization index and reconstruction.

    Levels come from originals, so nothing is sequential; the delta reads one tiled neighbour.
    """
    numbered = df.withColumn("level", level_number(value, start, offset))
    near = with_neighbours(numbered, keys, pos, ["level"], before=1)
    pred = level_value(F.col("level"), start, offset)
    return near.withColumn(
        "code", F.col("level") - F.coalesce("level_m1", F.lit(0)) + levels + LEVEL_BIAS).withColumn(
        "q", qz.quantize(value, pred, eb, radius)).withColumn(
        "recon", qz.requantized(value, pred, eb, radius)).drop("level_m1")


def cost_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with running counts, sums and square sums: O(1) cluster costs.

    Counts per distinct value come first, then stitched running sums, so many distinct values are fine.
    """
    v = F.col(value)
    grouped = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"_vn": v * F.col("n"), "_vvn": v * v * F.col("n")})
    return ordered_prefix(grouped, keys, [value], None, {"n": "cum_n", "_vn": "cum_sum", "_vvn": "cum_sq"}).select(
        *keys, value, "cum_n", "cum_sum", "cum_sq")


def _costs(cum: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Within-cluster squared error of sorted elements lo..hi from prefix sums: sums, squares and, if elements repeat, counts."""
    n = np.maximum(cum[2][hi + 1] - cum[2][lo] if len(cum) > 2 else hi - lo + 1, 1)
    s = cum[0][hi + 1] - cum[0][lo]
    return np.where(hi < lo, 0.0, cum[1][hi + 1] - cum[1][lo] - s * s / n)


def _next_row(prev: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more cluster: best last start per end, by divide and conquer on the monotone argmin.

    All sub-problems of one depth are scanned together.
    """
    n = len(prev)
    best, arg = np.full(n, np.inf), np.zeros(n, np.int64)
    todo = [(0, n - 1, 0, n - 1)]
    while todo:
        mids = np.array([(a + b) // 2 for a, b, _, _ in todo])
        los = np.array([c for _, _, c, _ in todo])
        his = np.minimum(np.array([d for _, _, _, d in todo]), mids)
        widths = his - los + 1
        ends = np.cumsum(widths)
        owner = np.repeat(np.arange(len(todo)), widths)
        j = los[owner] + np.arange(ends[-1]) - (ends - widths)[owner]
        before = np.where(j > 0, prev[np.maximum(j - 1, 0)], prev[0])
        total = before + _costs(cum, j, mids[owner])
        low = np.minimum.reduceat(total, ends - widths)
        first = np.minimum.reduceat(np.where(total == low[owner], j, n), ends - widths)
        best[mids], arg[mids] = low, first
        todo = [t for (a, b, c, d), m, k in zip(todo, mids, first)
                for t in ((a, m - 1, c, int(k)), (m + 1, b, int(k), d)) if t[0] <= t[1]]
    return best, arg


def cluster_centres(sample: np.ndarray, limit: int = MAX_LEVELS) -> np.ndarray:
    """Optimal 1-D k-means centres of plain values."""
    x = np.sort(np.asarray(sample, np.float64))
    return weighted_centres(np.ones(len(x)), x, x * x, limit)


def weighted_centres(count: np.ndarray, total: np.ndarray, squares: np.ndarray, limit: int = MAX_LEVELS) -> np.ndarray:
    """Optimal 1-D k-means centres of ordered elements, each a count, a sum and a sum of squares.

    k is where the cost ratio stops standing out; empty if nowhere.
    """
    n = len(count)
    if not n:
        return np.zeros(0)
    middle = total.sum() / count.sum()
    shifted = total - count * middle
    parts = (shifted, squares - 2 * middle * total + count * middle * middle, count)
    cum = np.stack([np.append(0.0, np.cumsum(part)) for part in parts])
    row = _costs(cum, np.zeros(n, np.int64), np.arange(n))
    args, average, chosen = [np.zeros(n, np.int64)], 0.0, 0
    for k in range(1, min(limit, n)):
        nxt, arg = _next_row(row, cum)
        args.append(arg)
        floor = 1e-12 * (1.0 + cum[1][-1])
        ratio = max(row[-1], floor) / max(nxt[-1], floor)
        average = (average * (k - 1) + ratio) / k
        row = nxt
        if ratio / average > STOP_RATIO:
            chosen = k + 1
        elif chosen:
            break
    centres, end = np.zeros(chosen), n
    for k in range(chosen - 1, -1, -1):
        begin = min(int(args[k][end - 1]), n - 1)
        stop = max(end, begin + 1)
        centres[k] = middle + (cum[0][stop] - cum[0][begin]) / (cum[2][stop] - cum[2][begin])
        end = max(begin, 1)
    return centres


def regular_levels(centres: np.ndarray, top: float) -> tuple[float, float, int]:
    """Evenly spaced levels that best match the centres; level count from the largest value."""
    k = len(centres)
    if k < 2:
        return 0.0, 0.0, 0
    offset = (centres[-1] - centres[0]) / (k - 1)
    start = float(np.mean(centres - np.arange(k) * offset))
    return start, float(offset), int(np.floor((top - start) / offset + 0.5)) + 1


def fit_levels(frame0: DataFrame, keys: list[str], value: str, bins: int = LEVEL_BINS) -> DataFrame:
    """Level start, offset and count per key from all values of the first frame.

    Values are summed (count, sum, squares) in ``bins`` equal slices of a key's range before they meet, so one group is one
    small array however many rows it has; levels closer than a slice are not told apart.  Null and non-finite values
    take no part.  Zero levels means none were found, or more than a quarter of the particle count.
    """
    v = F.col(value).cast("double")
    fine = frame0.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    facts = fine.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_top"), F.count(F.lit(1)).alias("_n"))
    placed = fine.select(*keys, v.alias("_v")).join(facts, keys) if keys else fine.select(v.alias("_v")).crossJoin(F.broadcast(facts))
    d = F.col("_v") - F.col("_lo")
    slot = F.least(F.floor(F.coalesce(F.try_divide(d * bins, F.col("_top") - F.col("_lo")), F.lit(0.0))), F.lit(bins - 1))
    cells = placed.groupBy(*keys, slot.alias("_bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("sq"),
        *[F.first(c).alias(c) for c in ("_lo", "_top", "_n")])

    @F.pandas_udf("struct<start: double, offset: double, levels: int>")
    def fit(n: pd.Series, s: pd.Series, sq: pd.Series, span: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([regular_levels(weighted_centres(*map(np.asarray, row)), top) for *row, top in zip(n, s, sq, span)],
                            columns=["start", "offset", "levels"])

    arrays = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_bin", "n", "s", "sq"))).alias("_c"),
                                      *[F.first(c).alias(c) for c in ("_lo", "_top", "_n")])
    fitted = arrays.withColumn("_f", fit("_c.n", "_c.s", "_c.sq", F.col("_top") - F.col("_lo")))
    levels = F.when(F.col("_f.levels") > F.col("_n") * F.lit(MAX_LEVEL_SHARE), 0).otherwise(F.col("_f.levels"))
    start = F.when(F.col("_f.levels") > 0, F.col("_f.start") + F.col("_lo")).otherwise(F.col("_f.start"))
    return fitted.select(*keys, start.alias("start"), "_f.offset", levels.alias("levels"))
