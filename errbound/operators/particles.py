"""Spatial blocking of particle sets ``(keys, [pid], x, y, z)``.

Positions snap to a grid of cells 2*eb wide; cells group into blocks of ``b`` cells per axis, eight
blocks into one super-block.  Particles are first aggregated to occupied cells, so coinciding
particles, however many, become one row with a count before anything is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errbound.functions.quantizer import grid_centre, grid_index
from errbound.functions.scalars import fixed_width
from errbound.operators.encoders import entropy_bits
from errbound.operators.ordering import lag_sparse, ordered_prefix, running_sum, with_position
from errbound.session import checkpointed

AXES = ("x", "y", "z")

# Limits of the blocking scheme.
RAW_RANGE = 1e6
RAW_CELLS = 2 ** 32
SINGLE_CELLS = 16
MAX_BLOCKS_PER_AXIS = 2e5
MAX_TRIAL_EXPONENT = 16

# Quartic in -log10(eb) for the formula mode, lowest power first.
FORMULA = (1.0, -14.75, 27.9583333333333333, -16.25, 3.04166666666666667)


def bounding_box(df: DataFrame, keys: list[str]) -> DataFrame:
    """Origin ``p*`` and extent ``r*`` per axis; one partial aggregation."""
    return df.groupBy(*keys).agg(
        *[F.min(a).alias(f"p{a}") for a in AXES],
        *[(F.max(a) - F.min(a)).alias(f"r{a}") for a in AXES])


def with_box(df: DataFrame, keys: list[str]) -> DataFrame:
    box = bounding_box(df, keys)
    return df.join(box, keys) if keys else df.crossJoin(F.broadcast(box))


def with_grid(df: DataFrame, keys: list[str], eb: float) -> DataFrame:
    """Grid cell ``q*`` per axis, measured from the box origin."""
    return with_box(df, keys).withColumns({f"q{a}": grid_index(a, f"p{a}", F.lit(eb)) for a in AXES})


def needs_raw(eb: float) -> Column:
    """Too wide a range for grid cells (or no numbers at all): such frames are stored as they are."""
    wide = F.lit(False)
    for a in AXES:
        wide = wide | (F.col(f"r{a}") > RAW_RANGE) | (F.col(f"r{a}") / F.lit(eb) >= RAW_CELLS)
    return F.coalesce(wide, F.lit(True))


def least_edge(eb: float) -> Column:
    """Smallest power of two that keeps the blocks per axis within their limit, so that block ids fit 64 bits."""
    need = F.greatest(*[F.col(f"r{a}") for a in AXES]) / F.lit(2.0 * eb * MAX_BLOCKS_PER_AXIS)
    return F.when(need > 1, F.pow(F.lit(2.0), F.ceil(F.log2(need)))).otherwise(1.0).cast("bigint")


def repair_sign(axis: str, eb: float) -> Column:
    """0 when the cell centre honours the bound, else the direction the decoder must move (-1, +1)."""
    centre = grid_centre(f"q{axis}", f"p{axis}", F.lit(eb))
    return F.when(F.abs(centre - F.col(axis)) > eb, F.when(centre > F.col(axis), -1).otherwise(1)).otherwise(0)


def decoded(axis: str, eb: float, repair: Column | None = None) -> Column:
    centre = grid_centre(f"q{axis}", f"p{axis}", F.lit(eb))
    return centre if repair is None else centre + repair * F.lit(eb)


def repair_list(df: DataFrame, keys: list[str], eb: float) -> DataFrame:
    """Positions whose centre misses the bound by rounding: ``pid * 2 + (centre above value)``."""
    signs = with_grid(df, keys, eb).withColumns({f"_u{a}": repair_sign(a, eb) for a in AXES})
    long = signs.select(*keys, "pid", F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(f"_u{a}").alias("u")) for a in AXES])).alias("e"))
    return long.where("e.u <> 0").select(
        *keys, F.col("e.axis").alias("axis"),
        (F.col("pid") * 2 + F.when(F.col("e.u") < 0, 1).otherwise(0)).alias("code"))


def _extent(axis: str, b: Column, eb: float) -> Column:
    """Super-blocks along an axis."""
    return F.floor((F.ceil(F.col(f"r{axis}") / (2.0 * b * F.lit(eb))) + 2) / F.lit(2))


def with_block_ids(grid: DataFrame, eb: float, b: tuple[Column, Column, Column]) -> DataFrame:
    """Add super-block id ``block``, octant ``oct`` and in-block position ``pos``."""
    c = {a: F.floor(F.col(f"q{a}") / w) for a, w in zip(AXES, b)}
    d = {a: F.col(f"q{a}") % w for a, w in zip(AXES, b)}
    nx, ny = _extent("x", b[0], eb), _extent("y", b[1], eb)
    half = {a: F.floor(c[a] / 2) for a in AXES}
    return grid.withColumns({
        "block": half["x"] + half["y"] * nx + half["z"] * nx * ny,
        "oct": c["x"] % 2 + (c["y"] % 2) * 2 + (c["z"] % 2) * 4,
        "pos": d["x"] + d["y"] * b[0] + d["z"] * b[0] * b[1],
    })


def constant_edge(b: int | tuple[int, int, int]) -> tuple[Column, Column, Column]:
    b = (b, b, b) if isinstance(b, int) else b
    return tuple(F.lit(int(v)).cast("bigint") for v in b)


def occupied_cells(blocked: DataFrame, keys: list[str]) -> DataFrame:
    """Occupied cells with their particle counts; partial counts absorb a crowded cell."""
    return blocked.groupBy(*keys, "block", "oct", "pos").agg(F.count(F.lit(1)).alias("n"))


# Block ids per bucket when blocks are put in order, and cells per bucket inside a block.
SAMPLE_EDGE = 7
BLOCK_BUCKET = 1 << 20
CELL_BUCKET = 1 << 20


def block_table(cells: DataFrame, keys: list[str], width: int = BLOCK_BUCKET) -> DataFrame:
    """Occupied blocks in id order with id deltas and particle counts."""
    blocks = cells.groupBy(*keys, "block").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("cells"))
    near = lag_sparse(blocks, keys, "block", ["block"], width=width)
    return near.select(*keys, "block", (F.col("block") - F.coalesce("prev_block", F.lit(0))).alias("delta"),
                       "count", "cells")


def cell_deltas(cells: DataFrame, keys: list[str], volume: int | Column, width: int = CELL_BUCKET) -> DataFrame:
    """Octant and position deltas of each occupied cell against the one before it in its block.

    The position restarts at each octant.  Further particles of a cell have both deltas zero.  Cells are
    distinct, so a block of known small volume is a bounded window; other blocks are bucketed.
    """
    v = F.lit(volume) if isinstance(volume, int) else volume
    ordered = cells.withColumn("_ord", (F.col("oct") * v + F.col("pos")).cast("bigint"))
    if isinstance(volume, int) and 8 * volume <= width:
        w = Window.partitionBy(*keys, "block").orderBy("oct", "pos")
        near = ordered.withColumns({"prev_oct": F.lag("oct").over(w), "prev_pos": F.lag("pos").over(w)})
    else:
        near = lag_sparse(ordered, keys + ["block"], "_ord", ["oct", "pos"], width=width)
    same = F.col("prev_oct").eqNullSafe(F.col("oct"))
    return near.select(
        *keys, "block", "oct", "pos", "n", "_ord",
        (F.col("oct") - F.coalesce("prev_oct", F.lit(0))).alias("oct_delta"),
        (F.col("pos") - F.when(same, F.col("prev_pos")).otherwise(0)).alias("pos_delta"))


def placed_deltas(deltas: DataFrame, keys: list[str], width: int = CELL_BUCKET) -> DataFrame:
    """Number the cells of each block in code order: the stored form of the delta streams."""
    return with_position(deltas, keys + ["block"], ["_ord"], "cell_no", width=width).select(
        *keys, "block", "cell_no", "oct_delta", "pos_delta", "n")


def restore_cells(placed: DataFrame, keys: list[str], width: int = CELL_BUCKET) -> DataFrame:
    """Inverse of the deltas: running sums give octant and position back."""
    octs = running_sum(placed, keys + ["block"], "cell_no", {"oct_delta": "oct"}, width)
    return running_sum(octs, keys + ["block", "oct"], "cell_no", {"pos_delta": "pos"}, width).select(
        *keys, "block", "oct", "pos", "n")


def restore_grid(cells: DataFrame, box: DataFrame, keys: list[str], eb: float,
                 b: tuple[int, int, int]) -> DataFrame:
    """Block, octant and position back to grid cells and centres."""
    both = cells.join(box, keys) if keys else cells.crossJoin(F.broadcast(box))
    edge = constant_edge(b)
    nx, ny = _extent("x", edge[0], eb), _extent("y", edge[1], eb)
    c = {"x": F.col("block") % nx * 2 + F.col("oct") % 2,
         "y": F.floor(F.col("block") / nx) % ny * 2 + F.floor(F.col("oct") / 2) % 2,
         "z": F.floor(F.col("block") / (nx * ny)) * 2 + F.floor(F.col("oct") / 4)}
    d = {"x": F.col("pos") % edge[0], "y": F.floor(F.col("pos") / edge[0]) % edge[1],
         "z": F.floor(F.col("pos") / (edge[0] * edge[1]))}
    with_q = both.withColumns({f"q{a}": c[a] * w + d[a] for a, w in zip(AXES, edge)})
    return with_q.withColumns({a: decoded(a, eb) for a in AXES})


def output_order(blocked: DataFrame, keys: list[str], volume: int, width: int = CELL_BUCKET) -> DataFrame:
    """Output position of every particle in (block, octant, position, pid) order.

    Starts of blocks and of cells come from running sums over the aggregated tables; the rank of a
    particle inside its cell is bucketed by pid, so a crowded cell is ranked by many tasks.
    """
    cells = occupied_cells(blocked, keys).withColumn("_ord", (F.col("oct") * volume + F.col("pos")).cast("bigint"))
    inner = ordered_prefix(cells, keys + ["block"], ["_ord"], None, {"n": "_upto"}, width=width)
    starts = inner.select(*keys, "block", "oct", "pos", (F.col("_upto") - F.col("n")).alias("_in_block"))
    blocks = cells.groupBy(*keys, "block").agg(F.sum("n").alias("n"))
    blocks = ordered_prefix(blocks, keys, ["block"], None, {"n": "_end"}, width=BLOCK_BUCKET).select(
        *keys, "block", (F.col("_end") - F.col("n")).alias("_block_start"))
    ranked = with_position(blocked.select(*keys, "block", "oct", "pos", "pid"),
                           keys + ["block", "oct", "pos"], ["pid"], "_rank", width=width)
    return (ranked.join(starts, keys + ["block", "oct", "pos"]).join(blocks, keys + ["block"])
            .select(*keys, "pid", (F.col("_block_start") + F.col("_in_block") + F.col("_rank")).alias("position")))


def stream_histograms(cells: DataFrame, keys: list[str], volume: int | Column) -> DataFrame:
    """Symbol frequencies of the four coded streams: block deltas, block counts, octants, positions."""
    blocks = block_table(cells, keys)
    deltas = cell_deltas(cells, keys, volume)
    parts = blocks.select(*keys, F.explode(F.array(
        F.struct(F.lit("block").alias("stream"), F.col("delta").alias("symbol"), F.lit(1).cast("bigint").alias("w")),
        F.struct(F.lit("count").alias("stream"), F.col("count").alias("symbol"), F.lit(1).cast("bigint").alias("w"))
    )).alias("e"))
    repeats = F.col("n") - 1
    inner = deltas.select(*keys, F.explode(F.array(
        F.struct(F.lit("octant").alias("stream"), F.col("oct_delta").alias("symbol"), F.lit(1).cast("bigint").alias("w")),
        F.struct(F.lit("position").alias("stream"), F.col("pos_delta").alias("symbol"), F.lit(1).cast("bigint").alias("w")),
        F.struct(F.lit("octant").alias("stream"), F.lit(0).cast("bigint").alias("symbol"), repeats.alias("w")),
        F.struct(F.lit("position").alias("stream"), F.lit(0).cast("bigint").alias("symbol"), repeats.alias("w"))
    )).alias("e"))
    both = parts.unionByName(inner).where("e.w > 0")
    return both.groupBy(*keys, F.col("e.stream").alias("stream"), F.col("e.symbol").alias("symbol")).agg(
        F.sum("e.w").alias("freq"))


def stream_sizes(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Coded size per stream: entropy or fixed length, whichever is smaller, and which it was."""
    f = F.col("freq")
    agg = hist.groupBy(*keys, "stream").agg(
        F.sum(f).alias("n"), F.sum(f * F.log2(f)).alias("_fl"), F.min("symbol").alias("_lo"), F.max("symbol").alias("_hi"))
    variable = F.col("n") * F.log2("n") - F.col("_fl")
    fixed = (F.col("n") * fixed_width(F.col("_hi") - F.col("_lo") + 1)).cast("double")
    return agg.select(*keys, "stream", "n", variable.alias("entropy_bits"), fixed.alias("fixed_bits"),
                      F.when(variable < fixed, "huffman").otherwise("fixed").alias("method"))


# ------------------------------------------------------------ block-size choice

def blocking_fallback(ranges: list[float], eb: float) -> int | None:
    """0: store raw; 1: one cell per block; None: search for a block edge."""
    if max(ranges) > RAW_RANGE or max(r / eb for r in ranges) >= RAW_CELLS:
        return 0
    return 1 if max(r / eb for r in ranges) <= SINGLE_CELLS else None


def exponent_range(r: float, eb: float) -> tuple[int, int]:
    """Smallest and largest block-edge exponent worth trying along one axis."""
    low = 0
    while math.ceil(r / (2.0 * (1 << low) * eb)) > MAX_BLOCKS_PER_AXIS:
        low += 1
    return low, math.ceil(math.log2(r / eb)) if r > 0 else 0


def search_span(ranges: list[float], eb: float) -> tuple[int, int]:
    spans = [exponent_range(r, eb) for r in ranges]
    return max(s[0] for s in spans), min(s[1] for s in spans)


def formula_edge(ranges: list[float], eb: float) -> int:
    """Block edge from the quartic, clamped to the search span of every axis."""
    x = -math.log10(eb)
    edge = int(sum(a * x ** k for k, a in enumerate(FORMULA)) + 0.1)
    spans = [exponent_range(r, eb) for r in ranges]
    edge = max([edge] + [1 << s[0] for s in spans])
    return min([edge] + [1 << s[1] for s in spans])


def entropy_candidates(df: DataFrame, ranges: list[float], eb: float) -> DataFrame:
    """Estimated bits per particle for each cubic block edge 2**a: coded id deltas plus 3a.

    Candidates are rows, so all of them are sized in one job.
    """
    low, high = search_span(ranges, eb)
    trials = []
    for a in range(low, high + 1):
        if 3 * a > 48:
            continue
        n = [math.ceil(r / (2.0 * (1 << a) * eb)) for r in ranges]
        if math.prod(n) <= 1e18:
            trials.append((a, 2.0 * eb * (1 << a), n[0] // SAMPLE_EDGE + 1, n[1] // SAMPLE_EDGE + 1))
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(w).alias("w"), F.lit(nx).alias("nx"), F.lit(ny).alias("ny"))
                       for a, w, nx, ny in trials])
    rows = df.select("x", "y", "z", F.explode(listed).alias("t"))
    bid = F.floor(F.col("x") / F.col("t.w") + (F.col("y") / F.col("t.w")
                                               + (F.col("z") / F.col("t.w")) * F.col("t.ny")) * F.col("t.nx"))
    ids = rows.groupBy(F.col("t.a").alias("a"), bid.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    near = lag_sparse(ids, ["a"], "id", ["id"], width=BLOCK_BUCKET)
    first = F.struct((F.col("id") - F.coalesce("prev_id", F.lit(0))).alias("symbol"), F.lit(1).cast("bigint").alias("w"))
    again = F.struct(F.lit(0).cast("bigint").alias("symbol"), (F.col("n") - 1).alias("w"))
    flat = near.select("a", F.explode(F.array(first, again)).alias("e")).where("e.w > 0")
    hist = flat.groupBy("a", F.col("e.symbol").alias("symbol")).agg(F.sum("e.w").alias("freq"))
    bits = entropy_bits(hist, ["a"])
    return bits.select("a", "n", (F.col("bits") / F.col("n") + 3 * F.col("a")).alias("bits_per_particle"))


def trial_sizes(df: DataFrame, ranges: list[float], eb: float,
                edges: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Trial-encode the set with several block edges at once and size all four streams.

    Default edges: the cubes of the search span; pass every (bx, by, bz) for the exhaustive mode.
    """
    if edges is None:
        low, high = search_span(ranges, eb)
        edges = [(1 << a,) * 3 for a in range(low, min(high, MAX_TRIAL_EXPONENT) + 1)]
    listed = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("bx", "by", "bz"), e)])
                       for e in edges])
    grid = with_grid(df.select("x", "y", "z"), [], eb).withColumn("t", F.explode(listed)).select("*", "t.*")
    keys = ["bx", "by", "bz"]
    cells = occupied_cells(with_block_ids(grid, eb, tuple(F.col(k) for k in keys)), keys)
    volume = F.col("bx") * F.col("by") * F.col("bz")
    sizes = stream_sizes(stream_histograms(cells, keys, volume), keys)
    return sizes.groupBy(*keys).agg(F.sum(F.least("entropy_bits", "fixed_bits")).alias("bits"))


def best_edge(sizes: DataFrame) -> DataFrame:
    """Smallest size wins, the smaller edge wins ties."""
    return sizes.agg(F.min(F.struct("bits", "bx", "by", "bz")).alias("s")).select("s.bx", "s.by", "s.bz", "s.bits")


def grid_cells(df: DataFrame, keys: list[str], eb: float) -> DataFrame:
    """Occupied grid cells of each key with their particle counts and the key's box; frames outside the grid are left out."""
    box = [f"{p}{a}" for p in "pr" for a in AXES]
    boxed = with_box(df.select(*keys, *AXES), keys).where(~needs_raw(eb))
    grid = boxed.withColumns({f"q{a}": grid_index(a, f"p{a}", F.lit(eb)) for a in AXES})
    return grid.groupBy(*keys, *[f"q{a}" for a in AXES]).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in box])


def candidate_edges(eb: float, most: int = MAX_TRIAL_EXPONENT) -> Column:
    """Cubic block edges worth trying for a key's box: powers of two whose block ids fit, up to the shortest axis."""
    low = F.log2(least_edge(eb).cast("double")).cast("int")
    spans = [F.when(F.col(f"r{a}") > 0, F.ceil(F.log2(F.col(f"r{a}") / F.lit(eb)))).otherwise(0) for a in AXES]
    high = F.greatest(F.least(*spans, F.lit(most)).cast("int"), low)
    return F.transform(F.sequence(low, high), lambda k: F.pow(F.lit(2.0), k).cast("bigint"))


def edge_bits(cells: DataFrame, keys: list[str], eb: float) -> DataFrame:
    """Coded bits of the four streams of each key's frame for every candidate edge.

    Particles are counted into occupied cells once; each candidate numbers those cells anew, so the work follows the
    occupied cells and not the particles, and frames choose side by side.
    """
    tried = cells.withColumn("edge", F.explode(candidate_edges(eb)))
    edge = F.col("edge")
    placed = with_block_ids(tried, eb, (edge, edge, edge)).select(*keys, "edge", "block", "oct", "pos", "n")
    sizes = stream_sizes(stream_histograms(checkpointed(placed), [*keys, "edge"], edge * edge * edge), [*keys, "edge"])
    return sizes.groupBy(*keys, "edge").agg(F.sum(F.least("entropy_bits", "fixed_bits")).alias("bits"))


def best_edges(df: DataFrame, keys: list[str], eb: float) -> DataFrame:
    """keys, ``edge``: the block edge that codes each key's frame in the fewest bits; the smaller edge wins ties."""
    bits = edge_bits(grid_cells(df, keys, eb), keys, eb)
    return bits.groupBy(*keys).agg(F.min(F.struct("bits", "edge")).alias("s")).select(*keys, "s.edge")
