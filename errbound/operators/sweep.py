"""Multi-level interpolation over a whole array of cells, as rows.

A lattice is refined level by level, and in a level axis by axis; each pass predicts the odd points of the axis from
reconstructions that the passes before left on its even points.  Lines are cut into blocks of ``block`` lattice points;
neighbouring blocks share the point between them, which is sent to both, so a pass is one shuffle of what is known so far
and windows are no longer than a block.  Known points double from pass to pass, so all passes together move about as many
rows as two copies of the array.  The closed loop never restarts: blocks hand their reconstructions on through the coarser levels.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errbound.functions import interpolators as ip
from errbound.functions import quantizer as qz
from errbound.operators.interp import COARSE_FROM, COARSE_RATIO
from errbound.session import ensure_checkpoint_dir

BLOCK = 32


def levels_of(shape: list[int]) -> int:
    """Halvings until one point is left on the longest axis."""
    return max((s - 1).bit_length() for s in shape)


def pass_of(axes: list[str], order: tuple[int, ...]) -> Column:
    """Number of the pass that predicts a cell: passes of a level follow each other, coarse levels have higher levels; -1 for the origin.

    A cell belongs to the level of the largest stride that divides all its coordinates, and there to the last axis of the
    order along which it is an odd multiple.
    """
    low = {a: F.col(a).bitwiseAND(-F.col(a)) for a in axes}
    stride = F.least(*[F.when(low[a] > 0, low[a]) for a in axes], F.lit(None)) if len(axes) > 1 else F.when(low[axes[0]] > 0, low[axes[0]])
    turn = F.coalesce(*[F.when(low[axes[k]] == stride, F.lit(t)) for t, k in reversed(list(enumerate(order)))])
    level = F.round(F.log2(stride.cast("double"))).cast("int") + 1
    return F.coalesce(level * len(axes) - turn, F.lit(-1)).cast("int")


def prediction(near: Callable[[int], Column], at: Column, n: Column, kind: str) -> Column:
    """Value of the stencil for the odd place ``at`` of a line of ``n`` lattice points; ``near(o)`` is the point ``o`` places on."""
    tail = F.when(n < 4, near(-1)).otherwise(ip.linear1(near(-3), near(-1)))
    linear = F.when(at + 1 < n, ip.linear(near(-1), near(1))).otherwise(tail)
    if kind == "linear":
        return linear
    return (F.when(n < 5, linear)
            .when((at >= 3) & (at + 3 < n), ip.cubic(near(-3), near(-1), near(1), near(3)))
            .when(at == 1, ip.quad_1(near(-1), near(1), near(3)))
            .when(at + 1 < n, ip.quad_2(near(-3), near(-1), near(1)))
            .otherwise(ip.quad_3(near(-5), near(-3), near(-1))))


def _passes(cells: DataFrame, keys: list[str], axes: list[str], shape: list[int], payload: list[str], step, kind: str, direction: int, block: int) -> DataFrame:
    """Run all passes; ``step(prediction, level)`` gives the columns a predicted cell is left with, ``recon`` among them."""
    if block % 2:
        raise ValueError("blocks need an even number of lattice points")
    order = list(permutations(range(len(axes))))[direction]
    coords = [*keys, *axes]
    spark = cells.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/sweep-{uuid.uuid4().hex}"
    staged = cells.select(*coords, *payload, pass_of(axes, order).alias("_pass"))
    staged.write.partitionBy("_pass").parquet(folder)  # each pass reads its own cells only
    stored = spark.read.schema(staged.schema).parquet(folder)
    known = stored.where("_pass = -1").drop("_pass")
    known = known.withColumns(step(F.lit(0.0), 0)).withColumn("_new", F.lit(False))
    for level in range(levels_of(shape), 0, -1):
        stride = 1 << (level - 1)
        for turn, k in enumerate(order):
            axis, size = axes[k], (shape[k] - 1) // stride
            if not size:
                continue
            mine = stored.where(F.col("_pass") == level * len(axes) - turn).drop("_pass")
            blank = {c: F.lit(None).cast(t) for c, t in known.dtypes if c not in mine.columns and c != "_new"}
            rows = known.unionByName(mine.withColumns(blank).withColumn("_new", F.lit(True)))
            at = F.floor(F.col(axis) / F.lit(stride))
            own = F.floor(at / block)
            rows = rows.withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(F.array(own, F.when((at % block == 0) & (at > 0), own - 1)))))
            line = Window.partitionBy(*keys, *[a for a in axes if a != axis], "_block").orderBy(axis)
            near = {o: (F.lag("recon", -o) if o < 0 else F.lead("recon", o)).over(line) for o in (-5, -3, -1, 1, 3)}
            rows = rows.withColumns({f"_at{o + 5}": c for o, c in near.items()}).where("_block = _own")
            place, n = at - F.col("_block") * block, F.least(F.lit(block), F.lit(size) - F.col("_block") * block) + 1
            filled = rows.withColumn("_pred", prediction(lambda o: F.col(f"_at{o + 5}"), place, n, kind))
            left = {c: F.when(F.col("_new"), x).otherwise(F.col(c)).alias(c) for c, x in step(F.col("_pred"), level).items()}
            known = filled.select(*coords, *[left.get(c, F.col(c)) for c in known.columns if c not in (*coords, "_new")], F.lit(False).alias("_new"))
    return known.drop("_new")


def sweep_rows(cells: DataFrame, keys: list[str], axes: list[str], shape: list[int], value: str, eb: float, radius: int = qz.DEFAULT_RADIUS,
               kind: str = "cubic", direction: int = 0, block: int = BLOCK) -> DataFrame:
    """Index ``q`` and reconstruction ``recon`` of every cell of complete arrays of one shape, closed loop.

    ``direction`` numbers the lexicographic orders of the axes.  The bound is halved on coarse levels.
    """
    def step(pred: Column, level: int) -> dict[str, Column]:
        bound = eb * COARSE_RATIO if level >= COARSE_FROM else eb
        return {"q": qz.quantize(value, pred, bound, radius), "recon": qz.requantized(value, pred, bound, radius)}

    return _passes(cells, keys, axes, shape, [value], step, kind, direction, block)


def unsweep_rows(coded: DataFrame, keys: list[str], axes: list[str], shape: list[int], stored: str, eb: float, radius: int = qz.DEFAULT_RADIUS,
                 kind: str = "cubic", direction: int = 0, block: int = BLOCK) -> DataFrame:
    """Inverse of :func:`sweep_rows`: ``recon`` from ``q``; cells with index 0 take the column ``stored``."""
    def step(pred: Column, level: int) -> dict[str, Column]:
        bound = eb * COARSE_RATIO if level >= COARSE_FROM else eb
        return {"recon": qz.recover("q", pred, bound, F.col(stored), radius)}

    return _passes(coded, keys, axes, shape, ["q", stored], step, kind, direction, block)
