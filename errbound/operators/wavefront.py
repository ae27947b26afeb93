"""Closed-loop Lorenzo prediction over a whole array, without a restart at tile edges.

An array is cut into tiles.  Tiles with equal coordinate sums depend on earlier sums only and run side by side; each takes
its lower halo from the faces of the finished tiles before it, one along each axis.  A face is a slab of the padded tile, so
the edges and corners that diagonal neighbours share travel in it as well.  An axis that is much longer than the others would
make a front of few tiles many times over, so its tiles are lengthened up to a bounded size.  Each front is one job over one
stored partition of tiles and the faces of the front before, and is written once: a lost executor costs its tiles of one front.
"""

from __future__ import annotations

import math
import uuid
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errbound.functions.quantizer import DEFAULT_RADIUS, quantize_step
from errbound.operators.slices import cuts
from errbound.session import ensure_checkpoint_dir

TILE = 64
#: Cells that a lengthened tile may hold.
CELLS = 1 << 18


def tile_edges(shape: list[int], tile: int) -> list[int]:
    """Tile edge of each axis: ``tile``, doubled on an axis with more tiles than all others, which only adds fronts."""
    edges = [tile] * len(shape)
    while True:
        counts = [-(-n // e) for n, e in zip(shape, edges, strict=True)]
        k = max(range(len(shape)), key=counts.__getitem__)
        cells = math.prod(min(2 * e if a == k else e, n) for a, (e, n) in enumerate(zip(edges, shape, strict=True)))
        if counts[k] <= max(sum(counts) - counts[k], 1) or cells > CELLS:
            return edges
        edges[k] *= 2


def _fronts(extent: tuple[int, ...]):
    """Cells of a padded tile in dependency order: index arrays of one coordinate sum after the other."""
    import numpy as np

    grid = np.indices(extent).reshape(len(extent), -1)
    order = np.argsort(grid.sum(axis=0), kind="stable")
    cuts = np.flatnonzero(np.diff(grid.sum(axis=0)[order])) + 1
    return [grid[:, part] + 1 for part in np.split(order, cuts)]


def fill_tiles(padded, source, extent: tuple[int, ...], eb: float, radius: int, stored=None):
    """Run through tiles of one extent at once.  ``padded`` [tiles, extent + 1...] holds the halos and receives the
    reconstructions; ``source`` are values to quantize, or indices if ``stored`` has the values of index 0."""
    import numpy as np

    strides = np.array([int(np.prod([e + 1 for e in extent[a + 1:]])) for a in range(len(extent))])
    flat = padded.reshape(len(padded), -1)
    steps = [(int(s @ strides), 1 if s.sum() % 2 else -1) for s in (np.array(x) for x in product((0, 1), repeat=len(extent))) if s.any()]
    inner = np.array([int(np.prod(extent[a + 1:])) for a in range(len(extent))])
    out = np.zeros((len(padded), int(np.prod(extent))), np.int32)
    for cells in _fronts(extent):
        at, place = strides @ cells, inner @ (cells - 1)
        pred = sum(sign * flat[:, at - back] for back, sign in steps)
        if stored is None:
            out[:, place], flat[:, at] = quantize_step(source[:, place], pred, eb, radius)
        else:
            q = source[:, place]
            flat[:, at] = np.where(q == 0, stored[:, place], pred + 2 * (q - radius) * eb)
    return out


def _runner(keys: list[str], axes: list[str], shape: list[int], edges: list[int], eb: float, radius: int, decode: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def sizes(batch):
            where = np.stack([batch.column(f"t_{a}").to_numpy() for a in axes], axis=1)
            return np.minimum(edges, np.array(shape) - where * edges)

        whole = (batch.slice(a, b - a) for batch in batches for a, b in cuts(sizes(batch).prod(axis=1), CELLS))
        for batch in whole:
            extents = sizes(batch)
            parts = []
            for extent in np.unique(extents, axis=0):
                rows = np.flatnonzero((extents == extent).all(axis=1))
                sub, size = batch.take(pa.array(rows)), tuple(int(e) for e in extent)
                padded = np.zeros((len(rows), *[e + 1 for e in size]))
                for k, a in enumerate(axes):
                    face = sub.column(f"face_{a}")
                    has = np.flatnonzero(~np.array(face.is_null()))
                    if len(has):
                        rest = [e + 1 for j, e in enumerate(size) if j != k]
                        padded[(has, *[0 if j == k else slice(None) for j in range(len(size))])] = face.drop_null().flatten().to_numpy().reshape(len(has), *rest)
                cells = int(np.prod(size))
                source = sub.column("source").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), cells)
                kept = sub.column("kept").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), cells) if decode else None
                q = fill_tiles(padded, source, size, eb, radius, kept)
                recon = padded[(slice(None), *[slice(1, None)] * len(size))].reshape(len(rows), -1)
                lists = {"q": source.astype(np.int32) if decode else q, "recon": recon,
                         **{f"face_{a}": padded[(slice(None), *[-1 if j == k else slice(None) for j in range(len(size))])].reshape(len(rows), -1) for k, a in enumerate(axes)}}
                columns = {c: sub.column(c) for c in (*keys, *(f"t_{a}" for a in axes))}
                for c, values in lists.items():
                    ends = np.arange(len(rows) + 1, dtype=np.int32) * values.shape[1]
                    columns[c] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))
                parts.append(pa.RecordBatch.from_pydict(columns))
            yield from parts
    return run


def _wavefront(cells: DataFrame, keys: list[str], axes: list[str], shape: list[int], source: str, kept: str | None, eb: float, radius: int, tile: int) -> DataFrame:
    spark, folder = cells.sparkSession, f"{ensure_checkpoint_dir(cells.sparkSession)}/wavefront-{uuid.uuid4().hex}"
    tiles = [f"t_{a}" for a in axes]
    types = dict(cells.dtypes)
    place, edges = F.lit(0), tile_edges(shape, tile)
    for a, n, edge in zip(axes, shape, edges, strict=True):
        start = F.floor(F.col(a) / edge) * edge
        place = place * F.least(F.lit(edge), F.lit(n) - start) + F.col(a) - start
    held = [F.col(source).alias("source"), *([F.col(kept).alias("kept")] if kept else [])]
    placed = cells.select(*keys, *[F.floor(F.col(a) / edge).alias(t) for a, t, edge in zip(axes, tiles, edges, strict=True)], F.struct(place.cast("int").alias("at"), *held).alias("cell"))
    packed = placed.groupBy(*keys, *tiles).agg(F.array_sort(F.collect_list("cell")).alias("cells"))  # a tile is bounded
    packed = packed.select(*keys, *tiles, "cells.source", *(["cells.kept"] if kept else []), sum((F.col(t) for t in tiles), F.lit(0)).cast("int").alias("front"))
    packed.write.partitionBy("front").parquet(f"{folder}/tiles")
    work = spark.read.schema(packed.schema).parquet(f"{folder}/tiles")
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{t} long" for t in tiles), "q array<int>", "recon array<double>", *(f"face_{a} array<double>" for a in axes)])
    run = _runner(keys, axes, shape, edges, eb, radius, kept is not None)
    last = sum((n - 1) // edge for n, edge in zip(shape, edges, strict=True))
    for front in range(last + 1):
        now = work.where(F.col("front") == front).drop("front")
        for a, t in zip(axes, tiles, strict=True):
            if front:
                before = spark.read.schema(schema).parquet(f"{folder}/done/front={front - 1}")
                face = before.select(*keys, *[(F.col(x) + 1 if x == t else F.col(x)).alias(x) for x in tiles], f"face_{a}")
                now = now.join(face, [*keys, *tiles], "left")
            else:
                now = now.withColumn(f"face_{a}", F.lit(None).cast("array<double>"))
        now.mapInArrow(run, schema).write.parquet(f"{folder}/done/front={front}")
    done = spark.read.schema(schema).parquet(*[f"{folder}/done/front={front}" for front in range(last + 1)])
    flat = done.select(*keys, *tiles, F.posexplode(F.arrays_zip("q", "recon")).alias("_at", "_c"))
    coords, left = {}, F.col("_at")
    for a, t, n, edge in reversed(list(zip(axes, tiles, shape, edges, strict=True))):
        extent = F.least(F.lit(edge), F.lit(n) - F.col(t) * edge)
        coords[a], left = (F.col(t) * edge + left % extent).alias(a), F.floor(left / extent)
    return flat.select(*keys, *[coords[a] for a in axes], F.col("_c.q").alias("q"), F.col("_c.recon").alias("recon"))


def lorenzo_closed(cells: DataFrame, keys: list[str], axes: list[str], shape: list[int], value: str, eb: float, radius: int = DEFAULT_RADIUS, tile: int = TILE) -> DataFrame:
    """keys, axes, ``q`` and ``recon`` of every cell of complete arrays of one shape; the tile edge does not change the rows."""
    return _wavefront(cells, keys, axes, shape, value, None, eb, radius, tile)


def lorenzo_recover(coded: DataFrame, keys: list[str], axes: list[str], shape: list[int], stored: str, eb: float, radius: int = DEFAULT_RADIUS, tile: int = TILE) -> DataFrame:
    """Inverse: ``recon`` from ``q``; cells with index 0 take the column ``stored``."""
    return _wavefront(coded, keys, axes, shape, "q", stored, eb, radius, tile)
