"""Short forms of the calls most users need: compress, decompress, verify, for arrays, particles and molecular dynamics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errbound.config import Algorithm, Config
from errbound.operators import particles as pt
from errbound.operators import stats
from errbound.plans import array_codec, md_codec, particle_codec, tuner
from errbound.sources import container as store

TRIAL_CHUNKS = 3
CHUNK_EDGE = {1: 1 << 16, 2: 256, 3: 64, 4: 16}


def compress(cells: DataFrame, dims: list[int], conf: Config, keys: list[str] | None = None,
             edge: list[int] | None = None) -> DataFrame:
    """``(keys, i0.., v)`` to a container table.  The automatic algorithm tunes per key."""
    keys, edge = keys or [], edge or [CHUNK_EDGE[len(dims)]] * len(dims)
    chunks = array_codec.to_chunks(cells, keys, dims, edge)
    if conf.algorithm is Algorithm.INTERP_LORENZO:
        count = math.prod(-(-n // e) for n, e in zip(dims, edge))
        return tuner.compress_tuned(chunks, keys, conf, max(tuner.SAMPLE_SHARE, TRIAL_CHUNKS / count))
    return array_codec.compress(chunks, keys, conf)


def decompress(container: DataFrame, conf: Config, rank: int, keys: list[str] | None = None) -> DataFrame:
    """A container table back to ``(keys, i0.., v)``."""
    back = tuner.decompress_tuned(container, conf) if "choice" in container.columns else \
        array_codec.decompress(container, conf)
    return array_codec.to_cells(back, keys or [], rank, {"decoded": "v"})


def verify(original: DataFrame, decoded: DataFrame, rank: int, keys: list[str] | None = None) -> DataFrame:
    """Distortion report of two cell tables, joined on their coordinates."""
    keys = keys or []
    at = keys + [f"i{a}" for a in range(rank)]
    both = original.select(*at, "v").join(decoded.select(*at, decoded["v"].alias("_d")), at)
    return stats.distortion(both, keys, "v", "_d")


def compress_particles(rows: DataFrame, path: str, eb: float, shape: tuple[int, int], batch: int = 0, edge: int | None = None, order_bits: int = 0, radius: int = 32768) -> None:
    """``(frame, pid, x, y, z)`` to a particle container at ``path``.

    With a batch size and several frames, prediction runs along time.  Without an edge each spatial frame gets the one that
    codes it best.  ``order_bits`` (32 or 64) keeps the permutation, which brings rows back under their pid.
    """
    frames, particles = shape
    facts = {"kind": "trajectory" if frames > 1 and batch else "frames", "eb": float(eb), "radius": radius, "frames": frames, "particles": particles}
    if facts["kind"] == "trajectory":
        key_frames, batches, order = particle_codec.compress_trajectory(rows, eb, batch, edge, radius)
        tables = (key_frames, batches)
    else:
        edges = particle_codec.best_edges(rows, ["frame"], eb) if edge is None else edge
        tables = (particle_codec.compress_frames(rows, ["frame"], eb, edges),)
        order = particle_codec.frame_order(rows, ["frame"], eb, edges) if order_bits else None
    store.write_particles(rows.sparkSession, path, facts, tables, order if order_bits else None, order_bits or 64)


def decompress_particles(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    """``frame, place, x, y, z`` of a particle container; ``place`` is the pid where the permutation was kept, else the output position."""
    facts, tables, order = store.read_particles(spark, path, frames)
    if facts["kind"] == "trajectory":
        rows = particle_codec.decompress_trajectory(*tables, facts["eb"], facts["radius"]).withColumn("frame", F.col("anchor") + F.col("step"))
        rows = rows if frames is None else rows.where(F.col("frame").isin(frames))
        key = "anchor"
    else:
        rows, key = particle_codec.decode_frames(tables[0], ["frame"]), "frame"
    placed = rows.withColumnRenamed("position", "place") if order is None else rows.join(order, [key, "position"]).withColumnRenamed("pid", "place")
    return placed.select(F.col("frame").cast("bigint").alias("frame"), F.col("place").cast("bigint").alias("place"), *pt.AXES)


def verify_particles(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """Distortion report per axis of ``(frame, pid, x, y, z)`` against rows under their pid."""
    named = decoded.select("frame", F.col("place").alias("pid"), *[F.col(a).alias(f"d{a}") for a in pt.AXES])
    both = original.join(named, ["frame", "pid"])
    long = both.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v"), F.col(f"d{a}").alias("d")) for a in pt.AXES])).alias("e"))
    return stats.distortion(long.select("e.*"), ["axis"], "v", "d")


def compress_md(rows: DataFrame, path: str, conf: Config, batch: int = 10, method: int = md_codec.ADAPTIVE) -> None:
    """``(axis, slot, frame, v)``, or ``(frame, slot, x, y, z)``, to a container at ``path``."""
    rows = rows if "axis" in rows.columns else md_codec.axis_rows(rows)
    store.write_container(md_codec.compress(rows, conf, batch, method), path, conf, ["batch"])


def decompress_md(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """``axis, frame, slot, v``; ``batches`` reads only their folders."""
    table, conf = store.read_container(spark, path)
    return md_codec.decompress(table if batches is None else table.where(F.col("batch").isin(batches)), conf)


def verify_md(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """Distortion report per axis."""
    rows = original if "axis" in original.columns else md_codec.axis_rows(original)
    both = rows.join(decoded.withColumnRenamed("v", "_d"), ["axis", "frame", "slot"])
    return stats.distortion(both, ["axis"], "v", "_d")
