"""Coding of block coefficients along the block sequence, without one task that runs through it.

Each coefficient is quantized against the reconstruction of the block before.  Reconstructions are an anchor plus a whole number of
double bounds; the anchor is the last value that was kept as it is (index 0), or zero.  So the state that a step
needs is nearly known beforehand: keeping a value after a long run of equal ones depends on the values alone, and elsewhere the
nearest multiple is taken.  All states are guessed at once, then every block repeats its step from the state before it; what
changes (ties, values at the edge of the range) is repeated until nothing does.  States in which no step changes anything
are those of the ordered run.  A change that travels from block to block first does so inside tiles of consecutive blocks, so that
the rounds over the whole sequence only carry what passes from tile to tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errbound.operators.ordering import running_sum, with_neighbours, with_position
from errbound.session import checkpointed

RADIUS = 32768
# Fixed values of the resynchronisation: how still counts as equal, as a share of the bound, and how many equal ones are coded.
STILL_SHARE = 1e-3
PATIENCE = 100
#: Consecutive blocks whose states are settled together.
SETTLED = 1 << 14


def _step(v: Column, anchor: Column, m: Column, kept: Column, eb: Column, radius: int) -> dict[str, Column]:
    """State and index after a block, from the anchor and multiple before it."""
    past = anchor + (2 * m).cast("double") * eb
    steps = F.floor(F.least(F.abs(v - past) / eb, F.lit(4e9))) + 1
    half = F.shiftright(steps, 1)
    moved = m + F.when(v < past, -half).otherwise(half)
    fits = (~kept) & (steps < 2 * radius) & (F.abs(anchor + (2 * moved).cast("double") * eb - v) <= eb)
    return {"anchor": F.when(fits, anchor).otherwise(v), "m": F.when(fits, moved).otherwise(0),
            "q": F.when(fits, F.lit(radius) + moved - m).otherwise(0).cast("int")}


def _settled(radius: int):
    """Repeat the steps of a tile from the state before it until nothing changes; each round takes the blocks after changed ones."""
    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("pos")
        v, eb, anchor, past_anchor = (np.array(tile.column(c).to_numpy(), float) for c in ("v", "eb", "anchor", "_past_anchor"))
        m, past_m, kept = (np.array(tile.column(c).to_numpy()) for c in ("m", "_past_m", "kept"))
        at = np.arange(len(v))
        with np.errstate(all="ignore"):
            while len(at):
                own, past = at[at > 0], at[at > 0] - 1
                past_anchor[own], past_m[own] = anchor[past], m[past]
                a, n, value, bound = past_anchor[at], past_m[at], v[at], eb[at]
                before = a + (2 * n).astype(float) * bound
                steps = np.floor(np.fmin(np.abs(value - before) / bound, 4e9)).astype(np.int64) + 1
                moved = n + np.where(value < before, -(steps >> 1), steps >> 1)
                fits = ~kept[at] & (steps < 2 * radius) & (np.abs(a + (2 * moved).astype(float) * bound - value) <= bound)
                a, n = np.where(fits, a, value), np.where(fits, moved, 0)
                changed = at[(n != m[at]) | ((a != anchor[at]) & ~(np.isnan(a) & np.isnan(anchor[at])))]
                anchor[at], m[at] = a, n
                at = changed[changed + 1 < len(v)] + 1
        out = {c: tile.column(c) for c in tile.column_names if c not in ("_tile", "_past_anchor", "_past_m")}
        return pa.table(out | {"anchor": pa.array(anchor), "m": pa.array(m, pa.int64())})

    return run


def _since(df: DataFrame, keys: list[str], flag: Column, name: str, facts: dict[str, str]) -> DataFrame:
    """Columns of the last flagged row at or before each row; null before the first."""
    marked = checkpointed(running_sum(df.withColumn("_flag", flag.cast("bigint")), keys, "pos", {"_flag": name}))
    starts = marked.where("_flag = 1").select(*keys, name, *[F.col(c).alias(out) for out, c in facts.items()])
    return marked.drop("_flag").join(starts, [*keys, name], "left").drop(name)


def code_coefficients(coefs: DataFrame, keys: list[str], order: list[str], value: str, bound: str, precision: float, radius: int = RADIUS,
                      still: float = STILL_SHARE, patience: int = PATIENCE, carry: list[str] | None = None) -> DataFrame:
    """keys, order, ``q`` and ``recon`` of each coefficient; ``keys`` name a coefficient's sequence, ``bound`` its error bound column.

    A value within ``still * precision`` of the one before is an equal one; the first after ``patience`` equal ones in a row
    is kept as it is, and so are values beyond the range of the indices.  Null and NaN values are kept as well.
    """
    named = [*keys, *order, *(carry or [])]
    # each step reads its input twice or more, so what a step gave is stored: else the first one is planned and run again for every later one
    given = checkpointed(coefs.select(*named, F.col(value).cast("double").alias("v"), F.col(bound).cast("double").alias("eb")))
    placed = with_position(given, keys, order, "pos")
    near = with_neighbours(placed, keys, "pos", ["v"], before=1)
    before = F.when(F.col("pos") == 0, 0.0).otherwise(F.col("v_m1"))
    equal = F.coalesce(F.abs(F.col("v") - before) < precision * still, F.lit(False))
    runs = _since(checkpointed(near.withColumn("_equal", equal)), keys, ~F.col("_equal"), "_run", {"_begin": "pos"})
    kept = (F.col("_equal") & (F.col("pos") - F.coalesce("_begin", F.lit(-1)) == patience + 1)) | F.col("v").isNull() | F.isnan("v")
    jump = ~F.coalesce(F.abs(F.col("v") - before) / F.col("eb") < 2 * radius - 1, F.lit(False))
    marked = checkpointed(runs.withColumn("kept", kept).withColumn("_reset", F.col("kept") | jump))
    anchored = _since(marked, keys, F.col("_reset"), "_segment", {"_anchor": "v"}).withColumn("anchor", F.coalesce("_anchor", F.lit(0.0)))
    nearest = F.round(F.least(F.greatest((F.col("v") - F.col("anchor")) / (2 * F.col("eb")), F.lit(-4e18)), F.lit(4e18))).cast("bigint")
    states = anchored.select(*named, "pos", "v", "eb", "kept", "anchor", F.when(F.col("_reset"), 0).otherwise(F.coalesce(nearest, F.lit(0))).cast("bigint").alias("m"))
    past_anchor, past_m = (F.when(F.col("pos") == 0, F.lit(0).cast(t)).otherwise(F.col(c)) for c, t in (("anchor_m1", "double"), ("m_m1", "bigint")))
    near = with_neighbours(states, keys, "pos", ["anchor", "m"], before=1)
    near = near.select(*states.columns, past_anchor.alias("_past_anchor"), past_m.alias("_past_m"), F.floor(F.col("pos") / SETTLED).alias("_tile"))
    states = checkpointed(near.groupBy(*keys, "_tile").applyInArrow(_settled(radius), states.schema))
    while True:
        linked = with_neighbours(states, keys, "pos", ["anchor", "m"], before=1)
        done = checkpointed(linked.withColumns({f"_{c}": x for c, x in _step(F.col("v"), past_anchor, past_m, F.col("kept"), F.col("eb"), radius).items()}))
        same = F.col("anchor").eqNullSafe(F.col("_anchor")) & (F.col("m") == F.col("_m"))
        states = done.select(*named, "pos", "v", "eb", "kept", F.col("_anchor").alias("anchor"), F.col("_m").alias("m"), F.col("_q").alias("q"))
        if not done.where(~same).limit(1).count():
            break
    return states.select(*named, "q", F.when(F.col("q") == 0, F.col("v")).otherwise(F.col("anchor") + (2 * F.col("m")).cast("double") * F.col("eb")).alias("recon"))
