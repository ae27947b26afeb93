"""Particle compression: single frames by spatial blocking, trajectories with temporal prediction.

A frame is stored as runs of occupied cells in code order, cut into chunks of bounded size.  Each
chunk restarts its deltas, so a chunk decodes on its own and a crowded block spans many chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from errbound.operators import encoders, lossless
from errbound.operators import particles as pt
from errbound.operators import temporal as tm
from errbound.operators.closed_loop import quantize_chunks, series_recover
from errbound.operators.encoders import _ragged_int
from errbound.operators.ordering import ordered_prefix, with_position
from errbound.operators.slices import by_slices
from errbound.session import checkpointed

CELLS_PER_CHUNK = 4096
STREAMS = ("block", "oct", "pos", "fix", "n")
NO_FIX = 13
#: What numbering of cells and output positions read of a particle, besides keys and id.
CELL_COLUMNS = ("block", "ord", "oct", "pos", "fix", *(f"{p}{a}" for p in "pr" for a in pt.AXES), "edge")


def _with_fix(df: DataFrame, eb: float) -> DataFrame:
    """Repair directions of the three axes as one base-3 digit string; 13 means none."""
    fix = F.lit(0)
    for a in pt.AXES:
        fix = fix * 3 + pt.repair_sign(a, eb) + 1
    return df.withColumn("fix", fix.cast("bigint"))


def _edge(eb: float, edge: Column) -> Column:
    small = F.lit(True)
    for a in pt.AXES:
        small = small & (F.col(f"r{a}") / F.lit(eb) <= pt.SINGLE_CELLS)
    return F.when(small, 1).otherwise(F.greatest(edge, pt.least_edge(eb))).cast("bigint")


def blocked(df: DataFrame, keys: list[str], eb: float, edge: int | DataFrame) -> DataFrame:
    """Attach box, grid, repair digits, block edge, block ids and the code-order key ``ord``.

    The edge is one number or a table of one per key (``keys, edge``), as :func:`best_edges` gives it.  Frames too wide for
    the grid are left to :func:`raw_rows`; on a fine grid the edge grows until the ids fit.
    """
    boxed = pt.with_box(df, keys).where(~pt.needs_raw(eb))
    if isinstance(edge, DataFrame):
        named = edge.withColumnRenamed("edge", "_edge")
        boxed = boxed.join(named, keys) if keys else boxed.crossJoin(F.broadcast(named))
    else:
        boxed = boxed.withColumn("_edge", F.lit(edge).cast("bigint"))
    grid = boxed.withColumns({f"q{a}": pt.grid_index(a, f"p{a}", F.lit(eb)) for a in pt.AXES})
    grid = _with_fix(grid, eb).withColumn("edge", _edge(eb, F.col("_edge"))).drop("_edge")
    e = F.col("edge")
    ids = pt.with_block_ids(grid, eb, (e, e, e))
    return ids.withColumn("ord", ((F.col("oct") * e * e * e + F.col("pos")) * 27 + F.col("fix")).cast("bigint"))


def numbered_cells(particles: DataFrame, keys: list[str]) -> DataFrame:
    """Occupied cells with their number in code order and the particles before them.

    The aggregated cells feed several ordered steps, so they are checkpointed once.
    """
    box = [f"{p}{a}" for p in "pr" for a in pt.AXES]
    cells = checkpointed(particles.groupBy(*keys, "block", "ord", "oct", "pos", "fix").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in box + ["edge"]]))
    inner = ordered_prefix(cells, keys + ["block"], ["ord"], "_in", {"n": "_upto"}, width=pt.CELL_BUCKET)
    blocks = cells.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_cells"), F.sum("n").alias("_n"))
    blocks = ordered_prefix(blocks, keys, ["block"], None, {"_cells": "_cells_end", "_n": "_n_end"},
                            width=pt.BLOCK_BUCKET).select(
        *keys, "block", (F.col("_cells_end") - F.col("_cells")).alias("_c0"), (F.col("_n_end") - F.col("_n")).alias("_n0"))
    return checkpointed(inner.join(blocks, keys + ["block"]).select(
        *keys, "block", "ord", "oct", "pos", "fix", "n", *box, "edge",
        (F.col("_c0") + F.col("_in")).alias("cell_no"),
        (F.col("_n0") + F.col("_upto") - F.col("n")).alias("first_position")))


def _coded_streams() -> Column:
    """Delta streams of one chunk of cells, coded; octants restart per block, positions per octant.  One chunk is worked on at a time."""
    @F.arrow_udf("struct<" + ", ".join(f"{f}: binary" for f in STREAMS) + ">")
    def run(block: pa.Array, octant: pa.Array, pos: pa.Array, fix: pa.Array, n: pa.Array) -> pa.Array:
        columns = [_ragged_int(c) for c in (block, octant, pos, fix, n)]
        off = columns[0][1]

        def delta(values, opens):
            return values - np.where(opens, 0, np.append(0, values[:-1]))

        out: dict[str, list[bytes]] = {f: [] for f in STREAMS}
        for start, end in zip(off[:-1], off[1:]):
            blocks, octs, at, fixes, counts = (c[0][start:end] for c in columns)
            opens = np.arange(end - start) == 0
            opens_block = opens | (np.diff(blocks, prepend=-1) != 0)
            opens_octant = opens_block | (np.diff(octs, prepend=-1) != 0)
            coded = (delta(blocks, opens), delta(octs, opens_block), delta(at, opens_octant), fixes, counts)
            for f, symbols in zip(STREAMS, coded):
                out[f].append(lossless.shrink(encoders.smaller_pack(symbols)))
        return pa.StructArray.from_arrays([pa.array(v, pa.binary()) for v in out.values()], list(out))

    return run(*[f"_s.{f}" for f in STREAMS])


def compress_cells(cells: DataFrame, keys: list[str], eb: float, size: int = CELLS_PER_CHUNK) -> DataFrame:
    """Numbered cells to container rows: header columns plus one coded stream per field."""
    head = [f"{p}{a}" for p in "pr" for a in pt.AXES] + ["edge"]
    chunks = cells.withColumn("chunk_id", F.floor(F.col("cell_no") / size)).groupBy(*keys, "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("cell_no", *STREAMS))).alias("_s"),
        F.min("first_position").alias("first_position"), *[F.first(c).alias(c) for c in head])
    return chunks.select(*keys, "chunk_id", "first_position", *head, F.lit(eb).alias("eb"), F.size("_s").alias("cells"),
                         _coded_streams().alias("_c")).select("*", "_c.*").drop("_c")


def best_edges(df: DataFrame, keys: list[str], eb: float) -> DataFrame:
    """The edges of the default mode, one per key, as a stored table that compression and permutation share."""
    return checkpointed(pt.best_edges(df, keys, eb))


def compress_frames(df: DataFrame, keys: list[str], eb: float, edge: int | DataFrame | None = None) -> DataFrame:
    """Compress each key's particle set (the single-frame and per-frame containers), wide frames as raw rows.

    Without an edge each frame gets the one that codes it best.
    """
    edge = best_edges(df, keys, eb) if edge is None else edge
    cells = compress_cells(numbered_cells(blocked(df, keys, eb, edge), keys), keys, eb)
    return cells.unionByName(raw_chunks(raw_rows(df, keys, eb), keys), allowMissingColumns=True)


def frame_order(df: DataFrame, keys: list[str], eb: float, edge: int | DataFrame | None = None) -> DataFrame:
    """The permutation ``pid -> position`` of :func:`compress_frames` with the same edges."""
    edge = best_edges(df, keys, eb) if edge is None else edge
    particles = checkpointed(blocked(df, keys, eb, edge).select(*keys, "pid", *CELL_COLUMNS))
    order = output_positions(particles, numbered_cells(particles, keys), keys)
    return order.unionByName(raw_rows(df, keys, eb).select(*keys, "pid", "position"))


def raw_rows(df: DataFrame, keys: list[str], eb: float) -> DataFrame:
    """Particles of frames outside the grid limits with their output position: id order, or coordinate order without ids."""
    wide = pt.with_box(df, keys).where(pt.needs_raw(eb))
    if "pid" in df.columns:
        return with_position(wide.select(*keys, "pid", *pt.AXES), keys, ["pid"], "position", width=pt.CELL_BUCKET)
    return with_position(wide.select(*keys, *pt.AXES), keys, list(pt.AXES), "position")


def raw_chunks(rows: DataFrame, keys: list[str], size: int = CELLS_PER_CHUNK) -> DataFrame:
    """Container rows of raw particles: exact coordinates in ``raw``, in output order."""
    grouped = rows.groupBy(*keys, F.floor(F.col("position") / size).alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("position", *pt.AXES))).alias("_r"), F.min("position").alias("first_position"))
    return grouped.select(*keys, "chunk_id", "first_position", F.transform(
        "_r", lambda r: F.struct(*[r[a].alias(a) for a in pt.AXES])).alias("raw"))


def decode_frames(container: DataFrame, keys: list[str]) -> DataFrame:
    """One row per particle: output position and coordinates, from cells and raw rows."""
    cells = expand_cells(decode_cells(container, keys), keys)
    if "raw" not in container.columns:
        return cells
    raw = container.where("raw IS NOT NULL").select(*keys, "first_position", F.posexplode("raw").alias("_i", "_r"))
    return cells.unionByName(raw.select(*keys, (F.col("first_position") + F.col("_i")).alias("position"), "_r.*"))


RAW_SCHEMA_TAIL = ", n bigint, payload binary"


def compress_raw(df: DataFrame, keys: list[str], eb: float) -> DataFrame:
    """Frames outside the grid limits, stored losslessly batch by batch without a shuffle."""
    wide = pt.with_box(df, keys).where(pt.needs_raw(eb)).select(*keys, *pt.AXES)
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)

    def store(batches):
        packer = zstandard.ZstdCompressor(level=lossless.LEVEL)
        for batch in batches:
            frame = batch.to_pandas()
            groups = frame.groupby(keys, sort=False) if keys else [((), frame)]
            for key, rows in groups:
                body = rows[list(pt.AXES)].to_numpy(np.float64).astype("<f8").T.tobytes()
                row = dict(zip(keys, key if isinstance(key, tuple) else (key,)))
                yield pa.RecordBatch.from_pylist([row | {"n": len(rows), "payload": packer.compress(body)}])

    return wide.mapInArrow(store, (schema + RAW_SCHEMA_TAIL).lstrip(", "))


def decompress_raw(container: DataFrame, keys: list[str]) -> DataFrame:
    schema = ", ".join([f"{k} {dict(container.dtypes)[k]}" for k in keys] + [f"{a} double" for a in pt.AXES])

    def load(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                xyz = np.frombuffer(unpacker.decompress(row["payload"]), "<f8").reshape(3, -1)
                yield pa.RecordBatch.from_pydict(
                    {k: [row[k]] * row["n"] for k in keys} | {a: xyz[i] for i, a in enumerate(pt.AXES)})

    return container.mapInArrow(load, schema)


def _segmented(delta: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Running sums that restart where ``opens`` is set."""
    total = np.cumsum(delta)
    base = np.where(opens, total - delta, 0)
    return total - base[np.maximum.accumulate(np.where(opens, np.arange(len(delta)), 0))]


def decode_cells(container: DataFrame, keys: list[str]) -> DataFrame:
    """Container rows back to occupied cells with centres, counts and output positions; raw rows are not cells."""
    if "raw" in container.columns:
        container = container.where("raw IS NULL")

    head = [f"{p}{a}" for p in "pr" for a in pt.AXES] + ["edge", "eb", "first_position"]
    names = ["block", "oct", "pos", "fix", "n", "before"]

    def restore(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, lengths = [], None
        for f in STREAMS:
            parts = [encoders.smaller_unpack(lossless.restore(b)) for b in batch.column(f).to_pylist()]
            lengths = [len(p) for p in parts]
            flat.append(np.concatenate(parts))
        row = np.repeat(np.arange(len(batch)), lengths)
        opens_chunk = np.diff(row, prepend=-1) != 0
        blocks = _segmented(flat[0], opens_chunk)
        opens_block = opens_chunk | (flat[0] != 0)
        octs = _segmented(flat[1], opens_block)
        opens_oct = opens_block | (np.diff(octs, prepend=-1) != 0)
        before = _segmented(flat[4], opens_chunk) - flat[4]
        parts = [blocks, octs, _segmented(flat[2], opens_oct), flat[3], flat[4], before]
        left = batch.select([*keys, *head]).take(pa.array(row))
        return pa.RecordBatch.from_pydict({c: left.column(c) for c in left.schema.names} | {c: pa.array(p) for c, p in zip(names, parts)})

    opened = container.select(*keys, *head, "cells", *STREAMS)
    schema = StructType([*[opened.schema[c] for c in (*keys, *head)], *[StructField(c, LongType()) for c in names]])
    cells = by_slices(opened, schema, "cells", restore)
    e = F.col("edge")
    nx, ny = (F.floor((F.ceil(F.col(f"r{a}") / (2.0 * e * F.col("eb"))) + 2) / F.lit(2)) for a in ("x", "y"))
    block = {"x": F.col("block") % nx, "y": F.floor(F.col("block") / nx) % ny, "z": F.floor(F.col("block") / (nx * ny))}
    half = {"x": F.col("oct") % 2, "y": F.floor(F.col("oct") / 2) % 2, "z": F.floor(F.col("oct") / 4)}
    inner = {"x": F.col("pos") % e, "y": F.floor(F.col("pos") / e) % e, "z": F.floor(F.col("pos") / (e * e))}
    digit = {"x": F.floor(F.col("fix") / 9) - 1, "y": F.floor(F.col("fix") / 3) % 3 - 1, "z": F.col("fix") % 3 - 1}
    centres = {a: (2 * ((block[a] * 2 + half[a]) * e + inner[a]) + 1).cast("double") * F.col("eb") + F.col(f"p{a}")
               + digit[a] * F.col("eb") for a in pt.AXES}
    return cells.select(*keys, (F.col("first_position") + F.col("before")).alias("position"), "n",
                        *[centres[a].alias(a) for a in pt.AXES])


def expand_cells(cells: DataFrame, keys: list[str], piece: int = 1 << 16) -> DataFrame:
    """One row per particle.  A crowded cell is first cut into pieces that spread over tasks."""
    pieces = cells.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(piece))))
    spread = pieces.repartition(*keys, "position", "_s") if keys else pieces.repartition("position", "_s")
    last = F.least(F.col("n"), F.col("_s") + piece) - 1
    return spread.withColumn("_k", F.explode(F.sequence(F.col("_s"), last))).select(
        *keys, (F.col("position") + F.col("_k")).alias("position"), *pt.AXES)


def output_positions(particles: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The permutation ``pid -> position`` that goes with the container (optional sink).

    Particles are read three times here and when cells are numbered: give them as a stored table.
    """
    at = keys + ["block", "ord"]
    ranked = with_position(particles.select(*at, "pid"), at, ["pid"], "_rank", width=pt.CELL_BUCKET)
    return ranked.join(cells.select(*at, "first_position"), at).select(
        *keys, "pid", (F.col("first_position") + F.col("_rank")).alias("position"))


# ---------------------------------------------------------------- trajectories

def _own_anchors(placed: DataFrame) -> DataFrame:
    """Anchor of each row: where the particle's unbroken run inside the frame's chain begins (a chain is at most a batch)."""
    run = F.col("frame") - F.row_number().over(Window.partitionBy("pid", "anchor").orderBy("frame"))
    return placed.withColumn("_run", run).withColumn(
        "anchor", F.min("frame").over(Window.partitionBy("pid", "anchor", "_run"))).drop("_run")


#: Block edge in the size estimates of a trajectory's frames.
ESTIMATE_EDGE = 8


def compress_trajectory(df: DataFrame, eb: float, batch: int, edge: int | None = 8, radius: int = 32768,
                        divisor: float = 1.0, group: int = 1024):
    """Compress ``(pid, frame, x, y, z)``: returns (key frames, temporal batches, permutation).

    Frames that start a chain (spatial choice or batch start) are spatial containers keyed by
    ``anchor``.  The frames after it are quantized against reconstructions, in the anchor's output order,
    and coded per group of particles.  A particle that appears late, or again after a gap, opens a chain of its own in
    that frame; anchors too wide for the grid are raw rows.  A particle is in a frame at most once.  Without an edge each
    anchor gets the one that codes it best.  The rows and their anchors are stored, since sizes, boxes, blocks and batches read
    them in turn.  Key frames are stored, so that they are coded once and the workers that code them are the ones that decode
    them later.
    """
    df = checkpointed(df.select("pid", "frame", *pt.AXES))
    sizes = tm.spatial_sizes(df, [], eb, ESTIMATE_EDGE if edge is None else edge).join(tm.temporal_sizes(df, [], eb, radius), "frame")
    chains = checkpointed(tm.chain_starts(tm.choose_frames(sizes, []), [], batch).select("frame", "anchor"))
    placed = checkpointed(_own_anchors(df.join(chains, "frame")).select("pid", "frame", "anchor", *pt.AXES))
    anchors = placed.where("frame = anchor").drop("frame")
    edge = best_edges(anchors, ["anchor"], eb / divisor) if edge is None else edge
    particles = checkpointed(blocked(anchors, ["anchor"], eb / divisor, edge))
    cells = numbered_cells(particles, ["anchor"])
    raw = checkpointed(raw_rows(anchors, ["anchor"], eb / divisor))
    key_frames = checkpointed(compress_cells(cells, ["anchor"], eb / divisor).unionByName(raw_chunks(raw, ["anchor"]), allowMissingColumns=True))
    order = output_positions(particles, cells, ["anchor"]).unionByName(raw.select("anchor", "pid", "position"))
    start = particles.select("anchor", "pid", *[
        pt.decoded(a, eb / divisor, pt.repair_sign(a, eb / divisor)).alias(f"start_{a}") for a in pt.AXES])
    start = start.unionByName(raw.select("anchor", "pid", *[F.col(a).alias(f"start_{a}") for a in pt.AXES]))
    later = placed.where("frame > anchor").withColumn("step", F.col("frame") - F.col("anchor") - 1)
    chained = later.groupBy("anchor", "pid").agg(
        F.array_sort(F.collect_list(F.struct("step", *pt.AXES))).alias("_s"))
    ready = chained.join(start, ["anchor", "pid"]).join(order, ["anchor", "pid"])
    axes = ready.select("anchor", "position", F.size("_s").alias("frames"), F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(f"_s.{a}").alias("vals"), F.col(f"start_{a}").alias("start"))
        for a in pt.AXES])).alias("e")).select("anchor", "position", "frames", "e.*")
    coded = quantize_chunks(axes, F.col("start"), eb, 1, radius)
    grouped = coded.groupBy("anchor", "axis", F.floor(F.col("position") / group).alias("group")).agg(
        F.array_sort(F.collect_list(F.struct("position", "frames", "q", "unpred"))).alias("_g"))
    batches = grouped.select(
        "anchor", "axis", "group",
        lossless.compress(encoders.pack(F.col("_g.position").cast("array<bigint>"), "auto")).alias("position"),
        lossless.compress(encoders.pack(F.col("_g.frames"), "auto")).alias("frames"),
        lossless.compress(encoders.pack(F.flatten("_g.q"), "auto")).alias("q"),
        F.flatten("_g.unpred").alias("unpred"))
    return key_frames, batches, order


def decompress_trajectory(key_frames: DataFrame, batches: DataFrame, eb: float, radius: int = 32768) -> DataFrame:
    """Rows ``anchor, position, step, x, y, z``; step 0 is the anchor frame itself.

    Batches meet their key frame through the equi-join on (anchor, position).
    """
    base = decode_frames(key_frames, ["anchor"])

    def cut(pieces):
        """A group of a batch is bounded, so groups are opened one at a time."""
        names = {"position": pa.int64(), "q": pa.list_(pa.int32()), "unpred": pa.list_(pa.float64())}
        for batch in pieces:
            for r in range(len(batch)):
                position, frames, q = (encoders.smaller_unpack(lossless.restore(batch.column(c)[r].as_py())) for c in ("position", "frames", "q"))
                ends = np.concatenate([[0], np.cumsum(frames)])
                lost = np.concatenate([[0], np.cumsum(q == 0)])[ends]
                held = {"position": pa.array(position), "q": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(q, pa.int32())),
                        "unpred": pa.ListArray.from_arrays(pa.array(lost, pa.int32()), batch.column("unpred")[r].values)}
                same = batch.select(["anchor", "axis"]).take(pa.array(np.full(len(position), r)))
                yield pa.RecordBatch.from_pydict({c: same.column(c) for c in ("anchor", "axis")} | {c: held[c].cast(t) for c, t in names.items()})

    schema = StructType([StructField("anchor", batches.schema["anchor"].dataType), StructField("axis", StringType()), StructField("position", LongType()),
                         StructField("q", ArrayType(IntegerType())), StructField("unpred", ArrayType(DoubleType()))])
    rows = batches.select("anchor", "axis", "position", "frames", "q", "unpred").mapInArrow(cut, schema)
    long_base = base.select("anchor", "position", F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(a).alias("start")) for a in pt.AXES])).alias("e")).select(
        "anchor", "position", "e.*")
    both = rows.join(long_base, ["anchor", "axis", "position"])
    decoded = both.withColumn("vals", series_recover(1, radius)("q", "unpred", "start", F.lit(float(eb))))
    steps = decoded.select("anchor", "position", "axis", F.posexplode("vals").alias("_i", "v")).groupBy(
        "anchor", "position", (F.col("_i") + 1).alias("step")).agg(*[
            F.max(F.when(F.col("axis") == a, F.col("v"))).alias(a) for a in pt.AXES])
    return base.select("anchor", "position", F.lit(0).alias("step"), *pt.AXES).unionByName(steps)
