"""How the test tables play the roles of series, arrays, particle sets and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errbound.operators.ordering import with_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-D series: one per user, ordered by (ts, event_id)."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


def placed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series with a dense position."""
    return with_position(series(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "pos", "event_id", "value")


def slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense array, one 64-value slice per vector: 64, 8x8 or 4x4x4 inside the slice."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("i0"), F.col("embedding").cast("array<double>").alias("row"))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particle set with many coinciding positions."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("y"),
        (F.col("l_discount") * F.lit(100.0)).alias("z"))


def orders_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particle set with a unique id."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pid"), (F.col("o_totalprice") / F.lit(1000.0)).alias("x"),
        (F.col("o_custkey") / F.lit(10.0)).alias("y"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("z"))


SERIES_SQL = """s AS (
  SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""

CELLS_SQL = """cells AS (
  SELECT vec_id AS i0, p, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings))"""

PARTICLES_SQL = """pts AS (
  SELECT l_quantity AS x, l_extendedprice / 1000.0::DOUBLE AS y, l_discount * 100.0::DOUBLE AS z
  FROM lineitem)"""

ORDERS_PARTICLES_SQL = """pts AS (
  SELECT o_orderkey AS pid, o_totalprice / 1000.0::DOUBLE AS x, o_custkey / 10.0::DOUBLE AS y,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS z
  FROM orders)"""


def quantize_sql(v: str, p: str, eb: float, radius: int) -> str:
    """SQL of the quantization index, for the oracles."""
    half = f"(CAST(floor(abs(({v}) - ({p})) * {1.0 / eb!r}::DOUBLE) AS BIGINT) + 1) // 2"
    sign = f"CASE WHEN ({v}) < ({p}) THEN -1 ELSE 1 END"
    rebuilt = f"(({p}) + CAST(2 * ({sign}) * ({half}) AS DOUBLE) * {eb!r}::DOUBLE)"
    return (f"CASE WHEN floor(abs(({v}) - ({p})) * {1.0 / eb!r}::DOUBLE) + 1 < {2 * radius} "
            f"AND abs({rebuilt} - ({v})) <= {eb!r}::DOUBLE "
            f"THEN {radius} + ({sign}) * ({half}) ELSE 0 END")


def recover_sql(q: str, v: str, p: str, eb: float, radius: int) -> str:
    return (f"CASE WHEN ({q}) = 0 THEN ({v}) ELSE ({p}) + CAST(2 * (({q}) - {radius}) AS DOUBLE) "
            f"* {eb!r}::DOUBLE END")
