"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and those neighbours none: one shuffle with partial sums."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select(F.col("v").alias("node"), F.lit(None).alias("to")))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("root"))
    return seen.where("low < high or (root and low is not null)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the edges (u, v); edges are stored each round."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        now = stored(_small(_large(now).where("u <> v")).where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after new links (u, v): only the components that the links join are solved anew."""
    ends = links
    for c in ("u", "v"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left")
    fresh = components(ends.select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v")))
    known = labels.join(fresh.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    kept = known.select("node", F.coalesce("to", "component").alias("component"))
    return kept.union(fresh.join(labels, "node", "left_anti").select("node", "component"))
