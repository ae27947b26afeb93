"""Samplers and quantizer-range estimators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errbound.functions.scalars import next_pow2_col

# Fixed values of the quantizer-range estimator.
MEAN_CAPACITY = 8192
SAMPLE_CAPACITY = 32768
ACCURACY = 0.999
MIN_INTERVALS = 32

# Largest sampled share of an array and the smallest usable sample block.
SAMPLE_SHARE = 0.035
MIN_SAMPLE_BLOCK = 9


def error_bin(error: Column, eb: float) -> Column:
    """Interval index of an absolute prediction error."""
    return F.least(F.floor((error / F.lit(float(eb)) + 1) / 2), F.lit(SAMPLE_CAPACITY - 1))


def quant_intervals(hist: DataFrame, bin_col: str = "bin", freq: str = "freq") -> DataFrame:
    """Smallest power-of-two interval count that covers 99.9 % of the sampled errors.

    The histogram has at most 32768 bins, so the running sum is over a bounded table.
    """
    w = Window.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    cum = hist.withColumn("_cum", F.sum(freq).over(w)).withColumn("_n", F.sum(freq).over(total))
    hit = cum.agg(
        F.min(F.when(F.col("_cum") > F.floor(F.col("_n") * F.lit(ACCURACY)), F.col(bin_col))).alias("_i"),
        F.sum(freq).alias("samples"))
    return hit.select("samples", F.greatest(
        F.lit(MIN_INTERVALS), 2 * next_pow2_col(2 * (F.coalesce("_i", F.lit(SAMPLE_CAPACITY - 1)) + 1))
    ).cast("bigint").alias("intervals"))


def mean_bin(value: Column, rough_mean: Column, eb: float) -> Column:
    """Bin of a value's distance from the rough mean, clamped to the table."""
    diff = value - rough_mean
    radius = MEAN_CAPACITY // 2
    scaled = diff / F.lit(float(eb))
    raw = F.when(diff > 0, F.floor(scaled) + radius).otherwise(F.ceil(scaled) - 1 + radius)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(MEAN_CAPACITY - 1))


def mean_frequency(hist: DataFrame, rough_mean: Column, eb: float, bin_col: str = "bin",
                   freq: str = "freq") -> DataFrame:
    """Most frequent pair of adjacent bins and the mean it suggests (first pair wins ties)."""
    shifted = hist.select((F.col(bin_col) - 1).alias(bin_col), F.col(freq).alias("_nxt"))
    pairs = hist.join(shifted, bin_col, "full").where(
        (F.col(bin_col) >= 1) & (F.col(bin_col) < MEAN_CAPACITY - 2)).select(
        bin_col, (F.coalesce(freq, F.lit(0)) + F.coalesce("_nxt", F.lit(0))).alias("_pair"))
    best = pairs.agg(F.max(F.struct("_pair", (-F.col(bin_col)).alias("_k"))).alias("_b"))
    n = hist.agg(F.sum(freq).alias("samples"))
    offset = (1 - F.col("_b._k") - MEAN_CAPACITY // 2).cast("double")
    return best.crossJoin(n).select(
        "samples", (-F.col("_b._k")).alias("bin"),
        (F.col("_b._pair") / F.col("samples")).alias("mean_freq"),
        (rough_mean + F.lit(float(eb)) * offset).alias("mean_guess"))


def rough_mean(cells: DataFrame, idx: str, value: str, dims: list[int]) -> DataFrame:
    """Mean over a strided walk: every sqrt(n)-th cell, one cell back at each row and plane turn.

    The k-th stop has a closed form, so the walk is a small range of stops joined to the cells.
    """
    n, plane, row = math.prod(dims), math.prod(dims[1:]), dims[-1]
    step = max(1, math.isqrt(n))
    k = F.col("id")
    stop = k * step - F.floor(k / -(-row // step)) - F.floor(k / -(-plane // step))
    stops = cells.sparkSession.range(2 * (n // step) + 2).select(stop.alias(idx)).where(F.col(idx) < n)
    return cells.join(stops, idx).agg(F.avg(value).alias("rough_mean"))


def sample_block(dims: list[int]) -> int | None:
    """Edge of the sampled corner blocks, or None when the whole array should be used."""
    dmin, n = min(dims), math.prod(dims)
    b = dmin
    while math.prod(d // dmin * 2 * b for d in dims) / n > SAMPLE_SHARE:
        b -= 1
    b = min(b, dmin // 2) if b * 2 > dmin else b
    return None if b < MIN_SAMPLE_BLOCK else b


def in_grid_sample(coords: list[Column], dims: list[int], block: int) -> Column:
    """Cells of two bands per cube edge: [B, 2B) and [d-2B, d-B) in every cube of edge d = min(dims)."""
    d = min(dims)
    hit = F.lit(True)
    for c, n in zip(coords, dims):
        local = c % d
        band = ((local >= block) & (local < 2 * block)) | ((local >= d - 2 * block) & (local < d - block))
        hit = hit & band & (c < n // d * d)
    return hit


def hashed_sample(df: DataFrame, keys: list[str], id_cols: list[str], n: int, seed: int = 16707) -> DataFrame:
    """A sample of ``n`` rows per key without replacement, decided by a hash of the id.

    Rows are thinned by the hash to about 4n per key before they are ranked, so no task ranks a whole
    key; a key of up to 4n rows is ranked whole.
    """
    unit = F.pmod(F.xxhash64(F.lit(seed), *id_cols), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    tagged = df.withColumn("_u", unit)
    tagged = tagged.join(sizes, keys) if keys else tagged.crossJoin(F.broadcast(sizes))
    thin = tagged.where(F.col("_u") * F.col("_n") <= 4 * n + 64)
    w = Window.partitionBy(*keys).orderBy("_u", *id_cols)
    return thin.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_u", "_n", "_r")


def shuffled(df: DataFrame, id_cols: list[str], seed: int = 16707) -> DataFrame:
    """Fixed-seed shuffle: a range-partitioned sort by a hash of the id."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *id_cols)).orderBy("_h", *id_cols).drop("_h")
