"""Containers as Parquet tables: chunks, per-frame particles, key frames with batches, permutations, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errbound.config import CONFIG_SCHEMA, Config


def write_container(container: DataFrame, path: str, conf: Config, partition_by: list[str] | None = None) -> None:
    """Chunk rows plus the configuration that decodes them.

    Partition columns (a frame, a batch) turn a later filter on them into a directory pick.
    """
    spark = container.sparkSession
    container.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{path}/chunks")
    spark.createDataFrame([conf.to_row()], CONFIG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def read_container(spark: SparkSession, path: str) -> tuple[DataFrame, Config]:
    """Chunk rows and their configuration (one row, read on the driver)."""
    conf = spark.read.parquet(f"{path}/config").first().asDict()
    return spark.read.parquet(f"{path}/chunks"), Config.from_row(conf)


def write_trajectory(key_frames: DataFrame, batches: DataFrame, path: str, order: DataFrame | None = None) -> None:
    """Key frames and batches as two tables that join on ``anchor``; optionally the permutation."""
    key_frames.write.mode("overwrite").partitionBy("anchor").parquet(f"{path}/keyframes")
    batches.write.mode("overwrite").partitionBy("anchor").parquet(f"{path}/batches")
    if order is not None:
        write_permutation(order, f"{path}/order", 64, ["anchor"])


def read_trajectory(spark: SparkSession, path: str, anchors: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables; ``anchors`` prunes to the wanted parts of the run."""
    tables = spark.read.parquet(f"{path}/keyframes"), spark.read.parquet(f"{path}/batches")
    return tables if anchors is None else tuple(t.where(F.col("anchor").isin(anchors)) for t in tables)


FACTS_SCHEMA = "kind string, eb double, radius int, frames bigint, particles bigint, ordered boolean"


def write_particles(spark: SparkSession, path: str, facts: dict, tables: tuple[DataFrame, ...], order: DataFrame | None = None, bits: int = 64) -> None:
    """A particle container that describes itself: what decodes it, one table of frames or key frames with batches, optionally the permutation."""
    if facts["kind"] == "trajectory":
        write_trajectory(*tables, path)
    else:
        tables[0].write.mode("overwrite").partitionBy("frame").parquet(f"{path}/frames")
    if order is not None:
        write_permutation(order, f"{path}/order", bits, ["anchor" if facts["kind"] == "trajectory" else "frame"])
    row = tuple((facts | {"ordered": order is not None})[c.split()[0]] for c in FACTS_SCHEMA.split(", "))
    spark.createDataFrame([row], FACTS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def read_particles(spark: SparkSession, path: str, frames: list[int] | None = None) -> tuple[dict, tuple[DataFrame, ...], DataFrame | None]:
    """Facts, tables and permutation; ``frames`` prunes single-frame containers to their folders."""
    facts = spark.read.parquet(f"{path}/facts").first().asDict()
    order = spark.read.parquet(f"{path}/order") if facts["ordered"] else None
    if facts["kind"] == "trajectory":
        return facts, read_trajectory(spark, path), order
    table = spark.read.parquet(f"{path}/frames")
    return facts, (table if frames is None else table.where(F.col("frame").isin(frames)),), order


def write_permutation(order: DataFrame, path: str, bits: int = 64, keys: list[str] | None = None) -> None:
    """Input id per output position, as 32- or 64-bit integers."""
    kind = {32: "int", 64: "bigint"}[bits]
    order.select(*(keys or []), F.col("position").cast(kind), F.col("pid").cast(kind)).write.mode("overwrite").partitionBy(
        *(keys or [])).parquet(path)


def write_text(df: DataFrame, path: str, order: str = "idx", value: str = "v") -> None:
    """One value per line; part files in order (a range-partitioned sort)."""
    df.orderBy(order).select(F.col(value).cast("string")).write.mode("overwrite").text(path)
