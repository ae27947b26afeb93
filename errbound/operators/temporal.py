"""Trajectories ``(keys, pid, frame, values)``: batches, key frames, temporal residuals, per-frame choice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errbound.functions import quantizer as qz
from errbound.operators import particles as pt
from errbound.operators.closed_loop import quantize_chunks
from errbound.operators.encoders import entropy_bits
from errbound.operators.ordering import to_chunks, with_neighbours
from errbound.session import checkpointed

# Fixed values of the back-off after spatial wins: the limit doubles up to 64, half of it is skipped.
BACKOFF_LIMIT = 64
# Frames that are summed up together when frames are chosen.
FRAME_SEGMENT = 4096
# Fixed values of the tighter bound on spatial frames.
TIGHT_FACTOR = 5.0
TIGHT_MIN_FRAMES = 64
TIGHT_JUMP = 1 << 16


def with_batch(df: DataFrame, size: int, frame: str = "frame") -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(frame) / F.lit(size)))


def temporal_batches(df: DataFrame, keys: list[str], value: str, eb: float, size: int, radius: int,
                     key_frame: DataFrame | None = None, layers: int = 1) -> DataFrame:
    """Closed-loop prediction along time, restarted per batch of ``size`` frames.

    Each particle's batch is one bounded array.  The first frame of a batch is predicted from
    ``key_frame`` (``keys, start``), an equi-join on the particle, or from zero; particles that the key frame
    lacks start from zero as well.
    """
    chunks = to_chunks(df, keys, "frame", value, size, chunk="batch")
    if key_frame is None:
        return quantize_chunks(chunks, F.lit(0.0), eb, layers, radius)
    started = chunks.join(key_frame, keys, "left").withColumn("start", F.coalesce("start", F.lit(0.0)))
    return quantize_chunks(started, F.col("start"), eb, layers, radius)


def first_frame(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where("frame = 0").select(*keys, F.col(value).alias("start"))


def temporal_sizes(df: DataFrame, keys: list[str], eb: float, radius: int) -> DataFrame:
    """Estimated coded bits of each frame when predicted from the frame before it.

    The estimate reads the original previous frame, so every frame is sized at once.  Unpredictable
    values cost their 32 bits.
    """
    near = with_neighbours(df, keys + ["pid"], "frame", list(pt.AXES), before=1)
    symbols = near.select(*keys, "frame", F.explode(F.array(*[
        qz.quantize(a, F.coalesce(f"{a}_m1", F.lit(0.0)), eb, radius) for a in pt.AXES])).alias("q"))
    hist = symbols.groupBy(*keys, "frame", "q").agg(F.count(F.lit(1)).alias("freq"))
    lost = hist.groupBy(*keys, "frame").agg(
        F.sum(F.when(F.col("q") == 0, F.col("freq")).otherwise(0)).alias("lost"))
    bits = entropy_bits(hist, keys + ["frame"])
    return bits.join(lost, keys + ["frame"]).select(
        *keys, "frame", (F.col("bits") + 32 * F.col("lost")).alias("temporal_bits"))


def spatial_sizes(df: DataFrame, keys: list[str], eb: float, edge: int) -> DataFrame:
    """Estimated coded bits of each frame on its own: the four streams of spatial blocking.

    Frames too wide for the grid cost their coordinates as they are; on a fine grid the edge grows with the frame.
    The occupied cells feed three ordered steps, so they are checkpointed once.
    """
    by_frame = keys + ["frame"]
    boxed = pt.with_box(df, by_frame)
    raw = boxed.where(pt.needs_raw(eb)).groupBy(*by_frame).agg((F.count(F.lit(1)) * 192.0).alias("spatial_bits"))
    grid = boxed.where(~pt.needs_raw(eb)).withColumns({f"q{a}": pt.grid_index(a, f"p{a}", F.lit(eb)) for a in pt.AXES})
    blocked = pt.with_block_ids(grid, eb, (F.greatest(F.lit(edge).cast("bigint"), pt.least_edge(eb)),) * 3)
    hist = pt.stream_histograms(checkpointed(pt.occupied_cells(blocked, by_frame)), by_frame, edge ** 3)
    sizes = pt.stream_sizes(hist, by_frame)
    return sizes.groupBy(*by_frame).agg(F.sum(F.least("entropy_bits", "fixed_bits")).alias("spatial_bits")).unionByName(raw)


# Entry states of a segment that do not depend on an earlier size: frames still to skip, by limit.
_LIMITS = [1 << k for k in range(BACKOFF_LIMIT.bit_length())]
_WAITING = [(skip, limit) for skip in range(1, BACKOFF_LIMIT // 2 + 1) for limit in _LIMITS]


def _follow(spatial: np.ndarray, temporal: np.ndarray):
    """What a segment of frames does to every state it may be entered with.

    While frames are skipped, the size to beat is the last frame's.  Else it is an earlier one: all that matters is the first
    frame whose temporal size is above it, one of the records of the temporal sizes.  Returns the records and, for each way through
    the segment, the state it ends in: ways that wait, that fail at the first frame (by limit), that begin the key, that fail at
    a later record.
    """
    top = np.maximum.accumulate(temporal)
    records = np.flatnonzero(np.append(True, temporal[1:] > top[:-1]))
    later = records[records > 0]
    starts = [(0, 0.0, skip, limit) for skip, limit in _WAITING]
    starts += [(1, spatial[0], limit >> 1, min(2 * limit, BACKOFF_LIMIT)) for limit in _LIMITS] + [(1, spatial[0], 0, 1)]
    starts += [(t + 1, spatial[t], 0, 2) for t in later]
    at, last, skip, limit = (np.array(x) for x in zip(*starts))
    last, active = last.astype(float), 0
    for t in range(len(spatial)):
        while active < len(at) and at[active] <= t:
            active += 1
        tested = skip[:active] == 0
        won = tested & (temporal[t] <= last[:active])
        lost = tested & ~won
        skip[:active] = np.where(lost, limit[:active] >> 1, np.maximum(skip[:active] - 1, 0))
        limit[:active] = np.where(won, 1, np.where(lost, np.minimum(2 * limit[:active], BACKOFF_LIMIT), limit[:active]))
        last[:active] = np.where(won, last[:active], spatial[t])
    return temporal[records], last, skip, limit


def _leave(state: tuple, records, last, skip, limit) -> tuple:
    """State after a segment, from the state before it: (size to beat, frames to skip, limit), or None before the first frame."""
    if state is None:
        way = len(_WAITING) + len(_LIMITS)
    elif state[1]:
        way = (state[1] - 1) * len(_LIMITS) + _LIMITS.index(state[2])
    else:
        record = int(np.searchsorted(records, state[0], "right"))
        if record == len(records):
            return (state[0], 0, 1)
        way = len(_WAITING) + (_LIMITS.index(state[2]) if record == 0 else len(_LIMITS) + record)
    return (float(last[way]), int(skip[way]), int(limit[way]))


def _decide(state: tuple | None, spatial: np.ndarray, temporal: np.ndarray):
    """Modes and tests of a segment's frames from the state it is entered with."""
    modes, tests = np.zeros(len(spatial), np.int32), np.zeros(len(spatial), bool)
    last, skip, limit = state or (None, 0, 1)
    for t, (own, diff) in enumerate(zip(spatial.tolist(), temporal.tolist())):
        tested = last is not None and skip == 0
        tests[t] = tested
        if tested and diff <= last:
            modes[t], limit = 1, 1
        elif tested:
            last, skip, limit = own, limit >> 1, min(limit * 2, BACKOFF_LIMIT)
        else:
            last, skip = own, max(skip - 1, 0)
    return modes, tests


def choose_frames(sizes: DataFrame, keys: list[str], segment: int = FRAME_SEGMENT) -> DataFrame:
    """Spatial (0) or temporal (1) coding per frame.

    Temporal wins when its estimate is at most the last spatial size; after spatial wins the test is
    skipped for a while.  Segments of frames are summed up side by side, each for every state it may be entered with; only
    these summaries, one a segment, are followed in order, and then all segments decide their frames from their own entry states.
    """
    types = dict(sizes.dtypes)
    frame = F.col("frame").cast("bigint")
    row = F.struct(frame.alias("frame"), F.col("spatial_bits").cast("double").alias("spatial"), F.col("temporal_bits").cast("double").alias("temporal"))
    packed = sizes.groupBy(*keys, F.floor(frame / segment).alias("_segment")).agg(F.array_sort(F.collect_list(row)).alias("_f"))
    packed = checkpointed(packed.select(*keys, "_segment", "_f.frame", "_f.spatial", "_f.temporal"))
    named = ", ".join(f"{k} {types[k]}" for k in keys) + (", " if keys else "")

    def follow(batches):
        for batch in batches:
            found = [_follow(np.array(s), np.array(t)) for s, t in zip(batch.column("spatial").to_pylist(), batch.column("temporal").to_pylist())]
            lists = [pa.array([x[k].tolist() for x in found], pa.list_(kind)) for k, kind in enumerate((pa.float64(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("_segment"), *lists], names=[*keys, "_segment", "records", "last", "skip", "limit"])

    def enter(group: pa.Table) -> pa.Table:
        group, state, entered = group.sort_by("_segment"), None, []
        for records, last, skip, limit in zip(*(group.column(c) for c in ("records", "last", "skip", "limit"))):
            entered.append(state)
            state = _leave(state, *(np.array(x.values) for x in (records, last, skip, limit)))
        columns = [pa.array([s[k] if s else None for s in entered], kind) for k, kind in enumerate((pa.float64(), pa.int32(), pa.int32()))]
        return pa.table([*(group.column(k) for k in keys), group.column("_segment"), *columns], names=[*keys, "_segment", "_last", "_skip", "_limit"])

    def decide(batches):
        for batch in batches:
            frames = batch.column("frame")
            ends = np.append(0, np.cumsum(pa.compute.list_value_length(frames).to_numpy(zero_copy_only=False)))
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
            entry = [None if a is None else (a, b, c) for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("_last", "_skip", "_limit")))]
            done = [_decide(e, np.array(s), np.array(t)) for e, s, t in zip(entry, batch.column("spatial").to_pylist(), batch.column("temporal").to_pylist())]
            modes, tests = (np.concatenate([np.zeros(0, kind), *(d[k] for d in done)]) for k, kind in ((0, np.int32), (1, bool)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in keys), frames.flatten(), pa.array(modes), pa.array(tests)], names=[*keys, "frame", "mode", "tested"])

    summaries = packed.select(*keys, "_segment", "spatial", "temporal").mapInArrow(
        follow, named + "_segment bigint, records array<double>, last array<double>, skip array<int>, limit array<int>")
    entries = summaries.withColumn("_one", F.lit(0)).groupBy(*keys, "_one").applyInArrow(
        lambda group: enter(group.drop_columns(["_one"])), named + "_segment bigint, _last double, _skip int, _limit int")
    both = packed.alias("p").join(entries.select(*(F.col(c).alias(c) for c in entries.columns)), [*keys, "_segment"])
    return both.mapInArrow(decide, named + "frame bigint, mode int, tested boolean")


def chain_starts(choices: DataFrame, keys: list[str], size: int) -> DataFrame:
    """For each frame the spatial frame its temporal chain starts from, inside its batch.

    The first frame that a batch has is its key frame.
    """
    w = Window.partitionBy(*keys, "batch").orderBy("frame")
    opened = with_batch(choices, size).withColumn(
        "_anchor", F.when((F.col("mode") == 0) | (F.row_number().over(w) == 1), F.col("frame")))
    return opened.withColumn("anchor", F.last("_anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_anchor")


def tight_factor(df: DataFrame, sizes: DataFrame, eb: float) -> DataFrame:
    """5 when spatial frames should use a tighter bound, else 1 (one row).

    Needs at least 64 frames, no particle jumping far between frames 0 and 1 (all are looked at), and
    temporal coding smaller than spatial in two of three probe frames.
    """
    frames = df.agg(F.max("frame").alias("_t"))
    two = df.where("frame <= 1").select("pid", "frame", *pt.AXES)
    near = with_neighbours(two, ["pid"], "frame", list(pt.AXES), before=1).where("frame = 1")
    jumps = near.agg(F.count(F.when(
        sum(((F.abs(F.col(a) - F.col(f"{a}_m1")) > TIGHT_JUMP * eb).cast("int") for a in pt.AXES), F.lit(0)) > 0,
        1)).alias("_jumps"))
    nt = F.col("_t")
    probes = sizes.crossJoin(F.broadcast(frames)).agg(F.count(F.when(
        (F.col("frame") == F.floor(nt / 2)) | (F.col("frame") == F.floor(nt / 4))
        | (F.col("frame") == F.floor(nt / 4) * 3), F.when(F.col("temporal_bits") < F.col("spatial_bits"), 1))).alias("_wins"))
    return frames.crossJoin(jumps).crossJoin(probes).select(
        (nt + 1).alias("frames"), F.col("_jumps").alias("jumps"), F.col("_wins").alias("wins"),
        F.when((nt + 1 >= TIGHT_MIN_FRAMES) & (F.col("_jumps") == 0) & (F.col("_wins") > 1), F.lit(TIGHT_FACTOR))
        .otherwise(1.0).alias("factor"))


def tight_schedule(spatial_frames: DataFrame, keys: list[str], nt: int, factor: float, size: int) -> DataFrame:
    """Bound divisor of each spatial frame of a batch: it shrinks by one stride per spatial frame to 1."""
    stride = min((factor - 1) / (size / 4), factor - 1)
    w = Window.partitionBy(*keys, "batch").orderBy("frame")
    nth = F.row_number().over(w) - 1
    return with_batch(spatial_frames, size).withColumn("divisor", F.when(
        F.col("frame") >= nt - 64, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.lit(factor) - nth * F.lit(stride))))


def reorder(df: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """Apply an output permutation (``pid, position``) to a frame."""
    return df.join(order, keys + ["pid"])
