"""Lorenzo stencils on slab rows ``(keys, i0, row ARRAY)``: one row holds one slice along dim 0.

The L-layer Lorenzo residual is the product over the axes of ``(1 - shift)**L``, with zero outside the
array.  Along dim 0 it is a tiled ``lag`` of whole rows, inside the rows of an Arrow batch it is a
vectorised difference, so the 26-term 3-D stencil needs one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errbound.operators.closed_loop import _ragged
from errbound.operators.ordering import TILE, with_neighbours

# Expected closed-loop noise of a Lorenzo stencil, in error bounds, by (layers, rank).
LORENZO_NOISE = {(1, 1): 0.5, (1, 2): 0.81, (1, 3): 1.22, (1, 4): 1.79,
                 (2, 1): 1.08, (2, 2): 2.76, (2, 3): 6.8}

# Binomial weights of (1 - shift)**L.
DIFFERENCE = {1: [1, -1], 2: [1, -2, 1]}


def layers_for(rank: int, layers: int) -> int:
    """4-D arrays know the one-layer stencil only."""
    return 1 if rank == 4 else layers


def difference_inside(row: str | Column, inner: list[int], axes: list[int], layers: int) -> Column:
    """L-th backward differences of row-major slices of extents ``inner`` along ``axes``.

    A vectorised pass over all slices of an Arrow batch.
    """
    @F.arrow_udf("array<double>")
    def run(rows: pa.Array) -> pa.Array:
        flat, offsets = _ragged(rows)
        cube = flat.reshape(-1, *inner)
        for axis in axes:
            for _ in range(layers):
                cube = np.diff(cube, axis=axis + 1, prepend=0.0)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(cube.ravel()))

    return run(row)


def _add_weighted(weight: int):
    return lambda a, b: a + weight * F.coalesce(b, F.lit(0))


def difference_across(row: Column, earlier: list[Column]) -> Column:
    """L-th backward difference between a slice and the slices before it (NULL slices count as 0)."""
    weights = DIFFERENCE[len(earlier)]
    out = row
    for j, prev in enumerate(earlier, start=1):
        out = F.zip_with(out, F.coalesce(prev, F.array().cast("array<double>")),
                         _add_weighted(weights[j]))
    return out


def lorenzo_residuals(df: DataFrame, keys: list[str], dims: list[int], layers: dict[str, int],
                      row: str = "row", i0: str = "i0", pred_dim: int | None = None,
                      tile: int = TILE) -> DataFrame:
    """Add one residual per entry of ``layers`` (result name -> order), all from the same shuffle.

    ``dims`` are the array extents, ``dims[0]`` is open.  ``pred_dim`` < rank uses the fastest axes only.
    """
    rank = len(dims)
    axes = list(range(rank))[rank - (pred_dim or rank):]
    inside = [a - 1 for a in axes if a]
    orders = {out: layers_for(rank, n) for out, n in layers.items()}
    reach = max(orders.values())
    work = with_neighbours(df, keys, i0, [row], before=reach, tile=tile) if 0 in axes else df
    for out, n in orders.items():
        expr = F.col(row)
        if 0 in axes:
            expr = difference_across(expr, [F.col(f"{row}_m{j}") for j in range(1, n + 1)])
        work = work.withColumn(out, difference_inside(expr, dims[1:], inside, n) if inside else expr)
    return work.drop(*[f"{row}_m{j}" for j in range(1, reach + 1)])


def lorenzo_residual(df: DataFrame, keys: list[str], dims: list[int], layers: int = 1, out: str = "residual",
                     **how) -> DataFrame:
    """A single residual; see :func:`lorenzo_residuals`."""
    return lorenzo_residuals(df, keys, dims, {out: layers}, **how)


def explode_slab(df: DataFrame, keys: list[str], cols: dict[str, str], i0: str = "i0") -> DataFrame:
    """Slab rows to one row per cell; ``p`` is the row-major position inside the slice."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    flat = df.select(*keys, i0, F.posexplode(zipped).alias("p", "_e"))
    return flat.select(*keys, i0, "p", *[F.col(f"_e.{s}").alias(d) for s, d in cols.items()])
