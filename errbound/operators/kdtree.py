"""k-d blocking: all nodes of a level split together at their exact median, axis by axis.

The tree is a small table of cuts, at most 2**levels numbers; a particle's node follows from it by one expression, so the plan
does not grow with the levels.  The medians of a level are found by counting: a first scan counts each node's values by sign, power of
two and FINE equal parts of it, a second one the values of the part that holds the median.  Only if the parts of all nodes together hold more
than EXACT particles are they cut into equal slices and counted again before.  Particles are kept with their node while the tree is built,
so that a level reads them about twice, and a scan leaves counts whose number does not follow the particles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errbound.operators.particles import AXES

SLICES = 4096
#: Parts of a power of two in a level's first scan.
FINE = 256
#: Particles whose values are counted one by one.
EXACT = 1 << 20


def _node(levels: int) -> Column:
    """Node of a particle after some levels of cuts: values equal to the median, and missing ones, stay left."""
    if not levels:
        return F.lit(1).cast("bigint")
    values = F.array(*[F.col(a).cast("double") for a in AXES])

    def down(node: Column, level: Column) -> Column:
        return node * 2 + F.when(F.element_at(values, level % 3 + 1) > F.element_at(F.col("_cuts"), node.cast("int")), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.lit(1).cast("bigint"), down)


def _part(x: Column) -> Column:
    """Number of a value's part of its power of two, in the values' order."""
    power = F.floor(F.least(F.log2(F.abs(x)), F.lit(1e4)))
    inside = F.floor((F.abs(x) / F.pow(F.lit(2.0), power) - 1) * FINE)
    inside = F.when(power > 1e3, 0).otherwise(F.greatest(F.least(inside, F.lit(FINE - 1)), F.lit(0)))
    return F.when(x == 0, 0).otherwise(F.signum(x) * ((power + 1100) * FINE + inside))


def _list(values: list, kind: str) -> Column:
    """A small list as a constant."""
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def _medians(placed: DataFrame, level: int) -> dict[int, float]:
    """Exact lower median of each node's values along the level's axis."""
    first = 1 << level
    v = F.col(AXES[level % 3])
    values = placed.where(v.isNotNull() & ~F.isnan(v)).select("node", v.alias("_v"))
    known: dict[int, tuple[float, float, int, int]] = {}
    while True:
        if known:
            lo, hi = (_list([known[n][k] if n in known else None for n in range(first, 2 * first)], "double") for k in range(2))
            ranks = _list([known[n][2] if n in known else None for n in range(first, 2 * first)], "bigint")
            at = (F.col("node") - first + 1).cast("int")
            x, low, high = F.col("_v"), F.element_at(lo, at), F.element_at(hi, at)
            rows = values.where((low < high) & x.between(low, high))
            few = sum(n for low_n, high_n, _, n in known.values() if low_n < high_n) <= EXACT
            slot = x if few else F.least(F.floor((x - low) / (high - low) * SLICES), F.lit(SLICES - 1)).cast("bigint")
            counts = rows.groupBy("node", slot.alias("slot"), F.element_at(ranks, at).alias("rank"))
        else:
            counts = values.groupBy("node", _part(F.col("_v")).cast("bigint").alias("slot"), F.lit(None).cast("bigint").alias("rank"))
        counts = counts.agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        by_node = Window.partitionBy("node")
        upto = counts.withColumn("upto", F.sum("n").over(by_node.orderBy("slot"))).withColumn(
            "rank", F.coalesce("rank", F.floor((F.sum("n").over(by_node) + 1) / 2)))
        found = upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).collect()
        known.update({r.node: (r.lo, r.hi, r["rank"] - r.upto + r.n, r.n) for r in found})
        if all(low == high for low, high, _, _ in known.values()):
            return {node: low for node, (low, _, _, _) in known.items()}


def kd_cuts(df: DataFrame, levels: int) -> list:
    """Cut of each inner node by its number less one; None where there is no particle."""
    cuts = [None] * max((1 << levels) - 1, 1)
    placed = df.select(*[F.col(a).cast("double").alias(a) for a in AXES], F.lit(1).cast("bigint").alias("node")).persist()
    for level in range(levels):
        for node, cut in _medians(placed, level).items():
            cuts[node - 1] = cut
        if level:
            before.unpersist()
        first, before = 1 << level, placed
        if level < levels - 1:
            cut = F.element_at(_list(cuts[first - 1:2 * first - 1], "double"), (F.col("node") - first + 1).cast("int"))
            node = F.col("node") * 2 + F.when(F.col(AXES[level % 3]) > cut, 1).otherwise(0)
            placed = placed.select(*AXES, node.alias("node")).persist()
    placed.unpersist()
    return cuts


def kd_nodes(df: DataFrame, levels: int) -> DataFrame:
    """Give each particle the node it falls in after ``levels`` median splits."""
    cuts = df.sparkSession.createDataFrame([(kd_cuts(df, levels),)], "_cuts array<double>")
    return df.crossJoin(F.broadcast(cuts)).withColumn("node", _node(levels)).drop("_cuts")


def kd_boxes(nodes: DataFrame) -> DataFrame:
    """Bounding box and size of each node."""
    return nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo_{a}") for a in AXES],
        *[F.max(a).alias(f"hi_{a}") for a in AXES])


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes of every ancestor: each leaf box folds into the nodes above it."""
    depth = F.length(F.bin("node"))
    up = boxes.withColumn("node", F.explode(F.transform(
        F.sequence(F.lit(0), depth - 1), lambda k: F.floor(F.col("node") / F.pow(F.lit(2.0), k)))))
    return up.groupBy("node").agg(
        F.sum("n").alias("n"), *[F.min(f"lo_{a}").alias(f"lo_{a}") for a in AXES],
        *[F.max(f"hi_{a}").alias(f"hi_{a}") for a in AXES])


def blocks_below(boxes: DataFrame, edge: tuple[float, float, float]) -> DataFrame:
    """Topmost nodes whose box fits inside ``edge``: the nodes that become blocks."""
    fits = F.lit(True)
    for a, e in zip(AXES, edge):
        fits = fits & (F.col(f"hi_{a}") - F.col(f"lo_{a}") < e)
    good = boxes.where(fits)
    parents = good.select(F.col("node").alias("_p"))
    return good.join(parents, F.floor(good["node"] / 2) == F.col("_p"), "left_anti")
