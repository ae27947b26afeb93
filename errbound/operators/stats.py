"""Ranges, error-bound resolution, distortion report, autocorrelation, compression ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errbound.config import Config, ErrorBoundMode
from errbound.functions import scalars
from errbound.operators.ordering import with_neighbours


def value_range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Min, max, range and count per key; partial aggregation merges before the shuffle."""
    return df.groupBy(*keys).agg(
        F.min(value).alias("v_min"), F.max(value).alias("v_max"),
        (F.max(value) - F.min(value)).alias("v_range"), F.count(value).alias("n"))


def resolve_bound(conf: Config, rng: Column, n: Column) -> Column:
    """Absolute bound that ``conf`` asks for, given a value range and a count."""
    relative = F.lit(float(conf.rel_bound)) * rng
    absolute = F.lit(float(conf.abs_bound))
    return {
        ErrorBoundMode.ABS: lambda: absolute,
        ErrorBoundMode.REL: lambda: relative,
        ErrorBoundMode.PSNR: lambda: scalars.psnr_bound(conf.psnr_bound, rng),
        ErrorBoundMode.NORM: lambda: scalars.l2norm_bound(conf.l2norm_bound, n),
        ErrorBoundMode.ABS_AND_REL: lambda: F.least(absolute, relative),
        ErrorBoundMode.ABS_OR_REL: lambda: F.greatest(absolute, relative),
    }[conf.mode]()


def with_bound(df: DataFrame, keys: list[str], value: str, conf: Config, out: str = "eb") -> DataFrame:
    """Attach the resolved absolute bound to every row.

    An absolute bound needs no pass over the data.  Otherwise the per-key range is joined back;
    without keys it is one row, which is broadcast.
    """
    if conf.mode is ErrorBoundMode.ABS:
        return df.withColumn(out, F.lit(float(conf.abs_bound)))
    facts = value_range(df, keys, value).withColumn(
        out, resolve_bound(conf, F.col("v_range"), F.col("n"))).select(*keys, out)
    return df.join(facts, keys) if keys else df.crossJoin(F.broadcast(facts))


def distortion(df: DataFrame, keys: list[str], original: str, decoded: str) -> DataFrame:
    """Distortion report per key in one aggregation pass."""
    o, d = F.col(original), F.col(decoded)
    err = F.abs(d - o)
    sums = df.groupBy(*keys).agg(
        F.count(o).alias("n"), F.min(o).alias("v_min"), F.max(o).alias("v_max"),
        F.max(err).alias("max_abs_err"),
        F.max(F.when(o != 0, err / F.abs(o))).alias("max_pw_rel_err"),
        F.sum(err * err).alias("_se"), F.sum(d * d).alias("_dd"), F.corr(o, d).alias("corr"))
    rng, mse = F.col("v_max") - F.col("v_min"), F.col("_se") / F.col("n")
    return sums.select(
        *keys, "n", "v_min", "v_max", rng.alias("v_range"), "max_abs_err",
        (F.col("max_abs_err") / rng).alias("max_rel_err"), "max_pw_rel_err",
        mse.alias("mse"), (20 * F.log10(rng) - 10 * F.log10(mse)).alias("psnr"),
        (F.sqrt(mse) / rng).alias("nrmse"), F.sqrt("_se").alias("norm_err"),
        (F.sqrt("_se") / F.sqrt("_dd")).alias("norm_err_rel"), "corr")


def autocorrelation(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Lag-1 autocorrelation along ``pos``; zero for a constant series.

    Expanding the centred product into plain sums keeps it to a single aggregation.
    """
    pairs = with_neighbours(df.select(*keys, pos, value), keys, pos, [value], after=1)
    x, nxt = F.col(value), F.col(f"{value}_p1")
    sums = pairs.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_var"),
        F.sum(x * nxt).alias("_xy"), F.sum(F.when(nxt.isNotNull(), x)).alias("_x"),
        F.sum(nxt).alias("_y"), F.count(nxt).alias("_k"))
    cross = F.col("_xy") - F.col("_m") * (F.col("_x") + F.col("_y")) + F.col("_k") * F.col("_m") * F.col("_m")
    return sums.select(*keys, "n", F.when(F.col("_var") == 0, 0.0).otherwise(
        F.try_divide(F.try_divide(cross, F.col("_k")), F.col("_var"))).alias("autocorr"))


def compression_ratio(df: DataFrame, keys: list[str], raw_bytes: str, payload: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(raw_bytes).alias("raw_bytes"), F.sum(F.octet_length(payload)).alias("packed_bytes"),
        (F.sum(raw_bytes) / F.sum(F.octet_length(payload))).alias("ratio"))
