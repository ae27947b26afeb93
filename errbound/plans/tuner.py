"""Automatic choice between interpolation and Lorenzo, by trial compression of a small sample."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errbound.config import Algorithm, Config, Interpolator
from errbound.operators.sampling import SAMPLE_SHARE
from errbound.plans import array_codec as codec

# Fixed values of the decision rule.
DIRECTION_GAIN = 1.02
LORENZO_RATIO_LIMIT = 80.0
LORENZO_TRIAL_BLOCK = 5
LORENZO_GAIN = 1.02
SMALL_BINS = 16384
SMALL_BINS_FROM_RATIO = 5.0
TIGHT_RELATIVE = 1.01e-6


def sample_chunks(chunks: DataFrame, keys: list[str], share: float | None = None, at_least: int = 4) -> DataFrame:
    """The chunks that trials run on, decided by a hash of their id; chunk 0 is always in.

    A known ``share`` is a plain filter on the chunk id, which moves below the gathering of chunks, so
    only sampled cells are shuffled.  Otherwise chunks are counted per key; small fields are used whole.
    """
    unit = F.pmod(F.xxhash64(*keys, "chunk_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if share is not None:
        return chunks.where((unit < share) | (F.col("chunk_id") == 0))
    sizes = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    both = chunks.join(sizes, keys) if keys else chunks.crossJoin(F.broadcast(sizes))
    wanted = F.greatest(F.lit(SAMPLE_SHARE), F.lit(float(at_least)) / F.col("_k"))
    return both.where((unit < wanted) | (F.col("chunk_id") == 0)).drop("_k")


def candidates(conf: Config) -> dict[str, Config]:
    """Configurations that compete; the last two refine Lorenzo in 3-D and under very tight bounds."""
    interp = conf.with_(algorithm=Algorithm.INTERP)
    last = math.factorial(conf.rank) - 1
    lorenzo = conf.with_(algorithm=Algorithm.LORENZO_REG, lorenzo=True, lorenzo2=True, regression=False,
                         regression2=False, block_size=LORENZO_TRIAL_BLOCK)
    named = {
        "lorenzo": lorenzo,
        "linear": interp.with_(interpolator=Interpolator.LINEAR),
        "cubic": interp.with_(interpolator=Interpolator.CUBIC),
        "linear_reversed": interp.with_(interpolator=Interpolator.LINEAR, interp_direction=last),
        "cubic_reversed": interp.with_(interpolator=Interpolator.CUBIC, interp_direction=last),
    }
    if conf.rank == 3:
        named["lorenzo_planes"] = lorenzo.with_(pred_dim=2)
    if conf.rel_bound < TIGHT_RELATIVE and conf.quant_bins != SMALL_BINS:
        named["lorenzo_few_bins"] = lorenzo.with_(quant_bins=SMALL_BINS)
    return named


def tune(chunks: DataFrame, keys: list[str], conf: Config, share: float | None = None) -> DataFrame:
    """One row per key: the ratios of all candidates and the ``choice``.

    Cubic must beat linear, a reversed axis order must gain 2 %, and Lorenzo must beat interpolation
    with both ratios below 80.
    """
    width = 4 if conf.element_type == "float32" else 8
    trials = candidates(conf)
    picked = codec.chunk_bounds(sample_chunks(chunks, keys, share), keys, conf)
    coded = picked.withColumns({f"_c_{n}": codec.quantized({"": c}, F.lit("")) for n, c in trials.items()})
    sizes = coded.select(*keys, F.size("vals").alias("n"), *[
        sum((F.octet_length(c) for c in codec.coded_columns(f"_c_{name}", conf).values()), F.lit(0)).alias(name)
        for name in trials])
    table = sizes.groupBy(*keys).agg(*[(F.sum("n") * width / F.sum(name)).alias(name) for name in trials])
    cubic = F.col("cubic") > F.col("linear")
    forward = F.greatest("linear", "cubic")
    reverse = F.when(cubic, F.col("cubic_reversed")).otherwise(F.col("linear_reversed"))
    turned = reverse > forward * DIRECTION_GAIN
    best = F.when(turned, reverse).otherwise(forward)
    use_lorenzo = (F.col("lorenzo") > best) & (F.col("lorenzo") < LORENZO_RATIO_LIMIT) & (best < LORENZO_RATIO_LIMIT)
    name = F.concat(F.when(cubic, "cubic").otherwise("linear"), F.when(turned, "_reversed").otherwise(""))
    stencil, ratio = F.lit("lorenzo"), F.col("lorenzo")
    for variant, floor in (("lorenzo_planes", 0.0), ("lorenzo_few_bins", SMALL_BINS_FROM_RATIO)):
        if variant in trials:
            gains = (F.col(variant) > ratio * LORENZO_GAIN) & (ratio > floor)
            stencil, ratio = F.when(gains, variant).otherwise(stencil), F.when(gains, F.col(variant)).otherwise(ratio)
    return table.withColumn("choice", F.when(use_lorenzo, stencil).otherwise(name))


def compress_tuned(chunks: DataFrame, keys: list[str], conf: Config, share: float | None = None) -> DataFrame:
    """Compress each key with the candidate that won its trial; the choice travels with the rows.

    A key without a trial keeps all its chunks and takes the cubic default.
    """
    choice = tune(chunks, keys, conf, share).select(*keys, "choice")
    both = chunks.join(choice, keys, "left") if keys else chunks.crossJoin(F.broadcast(choice))
    both = both.withColumn("choice", F.coalesce("choice", F.lit("cubic")))
    return codec.compress(both, keys, conf, candidates(conf))


def decompress_tuned(container: DataFrame, conf: Config) -> DataFrame:
    return codec.decompress(container, conf, candidates(conf))
