"""Molecular-dynamics compression: per axis and batch of frames, one of five predictors.

The unit of work is a tile: the frames of one batch for a bounded group of atoms.  Tiles are
independent; the predictor is chosen per axis for 50 batches at a time by trial sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from errbound.config import Config
from errbound.functions.quantizer import quantize_step
from errbound.operators import encoders, levels, lossless
from errbound.operators.closed_loop import _ragged, lorenzo_nd_recover, lorenzo_nd_step
from errbound.operators.slices import by_slices
from errbound.operators.transforms import unpivot_axes
from errbound.plans.array_codec import chunk_bounds
from errbound.session import checkpointed

# Method numbers, and batches between two selections.
ADAPTIVE, VQ, VQT, MT, LR, TS = -1, 0, 1, 2, 3, 4
SELECT_EVERY = 50
ATOMS_PER_TILE = 1024

STREAMS = ("q", "codes", "unpred")
PACKED = "struct<" + ", ".join(f"{n}: binary" for n in STREAMS) + ">"
LEVELS = "struct<start: double, offset: double, levels: int>"


def tiles(df: DataFrame, batch: int, atoms: int = ATOMS_PER_TILE) -> DataFrame:
    """``(axis, slot, frame, v)`` to tiles: frame-major values of up to ``batch`` x ``atoms``.

    ``slot`` is the atom number, once a frame at most: a second value for it is an error.  A tile spans the frames it has (``frames``) and the slots from ``slot0``;
    atoms that a frame lacks are filled with their last value and listed in ``absent``.  ``start`` holds the atoms' values
    in frame 0 of the run, 0 where there is none.
    """
    tagged = df.withColumn("batch", F.floor(F.col("frame") / batch)).withColumn("tile", F.floor(F.col("slot") / atoms))
    grouped = tagged.groupBy("axis", "batch", "tile").agg(
        F.array_sort(F.collect_list(F.struct("frame", "slot", "v"))).alias("_s"))
    first = df.where("frame = 0").withColumn("tile", F.floor(F.col("slot") / atoms)).groupBy("axis", "tile").agg(
        F.collect_list(F.struct("slot", "v")).alias("_f"))
    return grouped.join(first, ["axis", "tile"], "left").select("axis", "batch", "tile", _dense().alias("_d")).select(
        "axis", "batch", "tile", "_d.*")


def _dense() -> Column:
    """Frame-major values of a tile without holes, and which of them are fill."""
    @F.arrow_udf("struct<frames: array<bigint>, slot0: bigint, width: int, vals: array<double>, absent: array<int>, start: array<double>>")
    def run(frame: pa.Array, slot: pa.Array, v: pa.Array, slot_0: pa.Array, v_0: pa.Array) -> pa.Array:
        out = []
        for r in range(len(frame)):
            at, atom, value = (c[r].values.to_numpy(zero_copy_only=False) for c in (frame, slot, v))
            frames, row = np.unique(at, return_inverse=True)
            if len(np.unique(np.stack([at, atom]), axis=1).T) < len(at):
                raise ValueError("an atom has several values in one frame")
            low = int(atom.min())
            width = int(atom.max()) - low + 1
            vals, held = np.zeros((len(frames), width)), np.zeros((len(frames), width), bool)
            vals[row, atom - low], held[row, atom - low] = value, True
            if not held.all():
                vals[0, ~held[0]] = value[0]
                for t in range(1, len(frames)):
                    vals[t, ~held[t]] = vals[t - 1, ~held[t]]
            start = np.zeros(width)
            if slot_0[r].is_valid:
                first = slot_0[r].values.to_numpy(zero_copy_only=False) - low
                inside = (first >= 0) & (first < width)
                start[first[inside]] = v_0[r].values.to_numpy(zero_copy_only=False)[inside]
            out.append({"frames": frames, "slot0": low, "width": width, "vals": vals.ravel(),
                        "absent": np.flatnonzero(~held).astype(np.int32), "start": start})
        lists = {"frames": pa.list_(pa.int64()), "slot0": pa.int64(), "width": pa.int32(), "vals": pa.list_(pa.float64()),
                 "absent": pa.list_(pa.int32()), "start": pa.list_(pa.float64())}
        return pa.StructArray.from_arrays([pa.array([o[n] for o in out], t) for n, t in lists.items()], list(lists))

    return run("_s.frame", "_s.slot", "_s.v", "_f.slot", "_f.v")


def axis_rows(df: DataFrame) -> DataFrame:
    """3-D frames ``(frame, slot, x, y, z)`` to one matrix per axis."""
    return unpivot_axes(df, ["frame", "slot"])


def axis_levels(rows: DataFrame) -> DataFrame:
    """Level fit per axis from the first frame."""
    fit = levels.fit_levels(rows.where("frame = 0"), ["axis"], "v")
    return fit.select("axis", F.struct("start", "offset", "levels").alias("lv"))


def _encode(x: np.ndarray, start: np.ndarray, lv: dict, eb: float, method: int, radius: int):
    """One tile [frames, atoms]: indices and level codes."""
    q, recon = np.zeros(x.shape, np.int32), np.zeros(x.shape)
    codes = np.zeros(0, np.int64)
    if method == LR:
        q, _ = lorenzo_nd_step(x.reshape(1, -1), x.shape, np.array([eb]), radius)
        return q.reshape(x.shape), codes
    if method in (VQ, VQT):
        part = x if method == VQ else x[:1]
        number = np.floor((part - lv["start"]) / lv["offset"] + 0.5).astype(np.int64)
        codes = np.diff(number.ravel(), prepend=0) + lv["levels"] + levels.LEVEL_BIAS
        q[:len(part)], recon[:len(part)] = quantize_step(part, lv["start"] + number * lv["offset"], eb, radius)
        if method == VQ:
            return q, codes
    elif method == MT:
        q[0], recon[0] = quantize_step(x[0], start, eb, radius)
    else:
        prev = 0.0
        for a in range(x.shape[1]):
            q[0, a], prev = quantize_step(x[0, a:a + 1], prev, eb, radius)
            recon[0, a] = prev[0]
    for t in range(1, len(x)):
        q[t], recon[t] = quantize_step(x[t], recon[t - 1], eb, radius)
    return q, codes


def _decode(q: np.ndarray, codes: np.ndarray, stored: np.ndarray, start: np.ndarray, lv: dict, eb: float,
            method: int, radius: int) -> np.ndarray:
    if method == LR:
        return lorenzo_nd_recover(q.reshape(1, -1), stored.reshape(1, -1), q.shape, np.array([eb]), radius).reshape(q.shape)
    out = np.zeros(q.shape)

    def recover(t, pred):
        return np.where(q[t] == 0, stored[t], pred + 2 * (q[t] - radius) * eb)

    if method in (VQ, VQT):
        number = np.cumsum(codes - lv["levels"] - levels.LEVEL_BIAS).reshape(-1, q.shape[1])
        for t in range(len(number)):
            out[t] = recover(t, lv["start"] + number[t] * lv["offset"])
        if method == VQ:
            return out
    elif method == MT:
        out[0] = recover(0, start)
    else:
        prev = 0.0
        for a in range(q.shape[1]):
            prev = stored[0, a] if q[0, a] == 0 else prev + 2 * (q[0, a] - radius) * eb
            out[0, a] = prev
    for t in range(1, len(q)):
        out[t] = recover(t, out[t - 1])
    return out


def packed(method: Column, radius: int) -> Column:
    """Struct (q, codes, unpred) of a tile with columns vals, start, width, lv, eb, as compressed streams; one tile is worked on at a time."""
    @F.arrow_udf(PACKED)
    def run(vals: pa.Array, start: pa.Array, width: pa.Array, lv: pa.Array, eb: pa.Array, how: pa.Array) -> pa.Array:
        flat, off = _ragged(vals)
        first, first_off = _ragged(start)
        out: dict[str, list[bytes]] = {n: [] for n in STREAMS}
        for r, (w, level, bound, m) in enumerate(zip(*(c.to_pylist() for c in (width, lv, eb, how)))):
            x = flat[off[r]:off[r + 1]].reshape(-1, w)
            q, codes = _encode(x, first[first_off[r]:first_off[r + 1]], level, bound, m, radius)
            streams = (encoders.smaller_pack(q.ravel().astype(np.int64)), encoders.smaller_pack(codes), x[q == 0].astype("<f8").tobytes())
            for n, raw in zip(STREAMS, streams):
                out[n].append(lossless.shrink(raw))
        return pa.StructArray.from_arrays([pa.array(v, pa.binary()) for v in out.values()], list(out))
    return run("vals", "start", "width", "lv", "eb", method)


def prepared(rows: DataFrame, conf: Config, batch: int, atoms: int = ATOMS_PER_TILE,
             method: int = ADAPTIVE) -> DataFrame:
    """Tiles with level fit (where the method may use it) and the batch's absolute bound."""
    t = tiles(rows, batch, atoms)
    none = F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("offset"), F.lit(0).alias("levels"))
    if method in (MT, LR, TS):
        t = t.withColumn("lv", none)
    else:
        # One row per axis, read by the trial and by the coding.
        t = t.join(checkpointed(axis_levels(rows)), "axis", "left").withColumn("lv", F.coalesce("lv", none))
    return chunk_bounds(t, ["axis", "batch"], conf)


def select_methods(prep: DataFrame, radius: int) -> DataFrame:
    """Winner per axis and period of 50 batches, from trial sizes on the batch that opens the period.

    Level methods compete when levels exist, otherwise the Lorenzo method does; time prediction always.
    """
    probe = prep.where(F.col("batch") % SELECT_EVERY == 0)
    tried = probe.withColumn("method", F.explode(F.when(
        F.col("lv.levels") > 0, F.array(*map(F.lit, (VQ, VQT, MT)))).otherwise(F.array(F.lit(MT), F.lit(LR)))))
    sized = tried.withColumn("_c", packed(F.col("method"), radius))
    sizes = sized.groupBy("axis", F.floor(F.col("batch") / SELECT_EVERY).alias("period"), "method").agg(
        F.sum(sum((F.octet_length(f"_c.{n}") for n in STREAMS), F.lit(0))).alias("bytes"))
    return sizes.groupBy("axis", "period").agg(F.min(F.struct("bytes", "method")).alias("s")).select(
        "axis", "period", F.col("s.method").alias("method"))


def compress(rows: DataFrame, conf: Config, batch: int = 10, method: int = ADAPTIVE,
             atoms: int = ATOMS_PER_TILE) -> DataFrame:
    """``(axis, slot, frame, v)`` to container rows; ``start`` is kept where the method reads it."""
    prep = prepared(rows, conf, batch, atoms, method)
    if method == ADAPTIVE:
        period = F.floor(F.col("batch") / SELECT_EVERY)
        prep = prep.withColumn("period", period).join(
            select_methods(prep, conf.radius), ["axis", "period"], "left").drop("period").withColumn(
            "method", F.coalesce("method", F.lit(MT)))
    else:
        prep = prep.withColumn("method", F.lit(method))
    done = prep.withColumn("_c", packed(F.col("method"), conf.radius))
    start = F.when(F.col("method") == MT, F.col("start")).otherwise(F.array().cast("array<double>"))
    return done.select("axis", "batch", "tile", "frames", "slot0", "width", "absent", "method", "eb", "lv", start.alias("start"),
                       "_c.*")


def decompress(container: DataFrame, conf: Config) -> DataFrame:
    """Container rows to ``(axis, frame, slot, v)``: the rows that were put in."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, first_off = _ragged(batch.column("start"))
        frames, absent = batch.column("frames"), batch.column("absent")
        rows: dict[str, list[np.ndarray]] = {n: [] for n in ("tile", "frame", "slot", "v")}
        for r, (slot0, w, m, bound, level, q, codes, unpred) in enumerate(zip(*(batch.column(c).to_pylist() for c in (
                "slot0", "width", "method", "eb", "lv", *STREAMS)))):
            qs = encoders.smaller_unpack(lossless.restore(q)).reshape(-1, w)
            stored = np.zeros(qs.shape)
            stored[qs == 0] = np.frombuffer(lossless.restore(unpred), "<f8")
            vals = _decode(qs, encoders.smaller_unpack(lossless.restore(codes)), stored,
                           first[first_off[r]:first_off[r + 1]], level, bound, m, conf.radius).ravel()
            kept = np.delete(np.arange(len(vals)), absent[r].values.to_numpy())
            rows["tile"].append(np.full(len(kept), r))
            rows["frame"].append(frames[r].values.to_numpy()[kept // w])
            rows["slot"].append(slot0 + kept % w)
            rows["v"].append(vals[kept])
        flat = {n: np.concatenate(parts) for n, parts in rows.items()}
        return pa.RecordBatch.from_pydict({"axis": batch.column("axis").take(pa.array(flat.pop("tile")))} | {n: pa.array(x) for n, x in flat.items()})

    opened = container.select("axis", "frames", "slot0", "width", "absent", "method", "eb", "lv", "start", *STREAMS,
                              (F.size("frames") * F.col("width")).alias("cells"))
    schema = StructType([opened.schema["axis"], StructField("frame", LongType()), StructField("slot", LongType()), StructField("v", DoubleType())])
    return by_slices(opened, schema, "cells", run)
