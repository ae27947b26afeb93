"""Closed-loop prediction: each prediction reads reconstructions, not originals.

The recurrence is sequential inside a chunk and independent between chunks, so Spark spreads the
chunks and one Arrow batch advances all of its chunks together, one position at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errbound.functions.quantizer import DEFAULT_RADIUS, quantize_step
from errbound.operators.ordering import to_chunks, with_position

CHUNK = 4096


def _ragged(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat float64 values and offsets of an Arrow list column; doubles are a read-only view of the batch, not a copy."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    offsets = arr.offsets.to_numpy().astype(np.int64)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat, offsets - offsets[0]


def _lockstep(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (t, chunk numbers still running, their flat positions) for t = 0, 1, ..."""
    lengths = np.diff(offsets)
    by_length = np.argsort(-lengths, kind="stable")
    running = lengths[by_length]
    for t in range(int(running[0]) if len(running) else 0):
        live = by_length[:np.searchsorted(-running, -t, side="left")]
        yield t, live, offsets[live] + t


def _listed(offsets: np.ndarray, **columns) -> pa.StructArray:
    off = pa.array(offsets.astype(np.int32))
    arrays = [pa.ListArray.from_arrays(off, pa.array(c)) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def series_quantizer(layers: int = 1, radius: int = DEFAULT_RADIUS):
    """UDF (vals, start, eb) -> struct(q, recon): 1-D Lorenzo of order 1 or 2 over each array.

    ``start`` predicts the first element; the element before it counts as zero.
    """
    @F.arrow_udf("struct<q: array<int>, recon: array<double>>")
    def run(vals: pa.Array, start: pa.Array, eb: pa.Array) -> pa.Array:
        flat, offsets = _ragged(vals)
        first = start.to_numpy(zero_copy_only=False).astype(np.float64)
        bound = eb.to_numpy(zero_copy_only=False).astype(np.float64)
        q, recon = np.zeros(len(flat), np.int32), np.zeros(len(flat))
        for t, live, at in _lockstep(offsets):
            if t == 0:
                pred = first[live]
            elif layers == 1:
                pred = recon[at - 1]
            else:
                pred = 2 * recon[at - 1] - (recon[at - 2] if t > 1 else 0.0)
            q[at], recon[at] = quantize_step(flat[at], pred, bound[live], radius)
        return _listed(offsets, q=q, recon=recon)

    return run


def series_recover(layers: int = 1, radius: int = DEFAULT_RADIUS):
    """UDF (q, unpredictable, start, eb) -> array<double>: inverse of :func:`series_quantizer`.

    ``unpredictable`` lists the stored values in stream order.
    """
    @F.arrow_udf("array<double>")
    def run(q: pa.Array, unpred: pa.Array, start: pa.Array, eb: pa.Array) -> pa.Array:
        idx, offsets = _ragged(q)
        stored, stored_off = _ragged(unpred)
        first = start.to_numpy(zero_copy_only=False).astype(np.float64)
        bound = eb.to_numpy(zero_copy_only=False).astype(np.float64)
        recon, taken = np.zeros(len(idx)), stored_off[:-1].copy()
        for t, live, at in _lockstep(offsets):
            if t == 0:
                pred = first[live]
            elif layers == 1:
                pred = recon[at - 1]
            else:
                pred = 2 * recon[at - 1] - (recon[at - 2] if t > 1 else 0.0)
            recon[at] = pred + 2 * (idx[at] - radius) * bound[live]
            lost = idx[at] == 0
            recon[at[lost]] = stored[taken[live[lost]]]
            taken[live[lost]] += 1
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(recon))

    return run


def lorenzo_series(df: DataFrame, keys: list[str], order: list[str], value: str, eb, layers: int = 1,
                   radius: int = DEFAULT_RADIUS, length: int = CHUNK) -> DataFrame:
    """Closed-loop 1-D Lorenzo of each key's series, restarted every ``length`` positions.

    Result: one row per chunk with ``vals``, ``q``, ``recon`` and the unpredictable list ``unpred``.
    """
    placed = with_position(df.select(*keys, *order, value), keys, order)
    chunks = to_chunks(placed, keys, "pos", value, length)
    return quantize_chunks(chunks, F.lit(0.0), eb, layers, radius)


def quantize_chunks(chunks: DataFrame, start, eb, layers: int = 1,
                    radius: int = DEFAULT_RADIUS) -> DataFrame:
    bound = F.lit(float(eb)) if isinstance(eb, (int, float)) else eb
    done = chunks.withColumn("_s", series_quantizer(layers, radius)("vals", start, bound))
    return (done.withColumn("q", F.col("_s.q")).withColumn("recon", F.col("_s.recon")).drop("_s")
            .withColumn("unpred", unpredictables(F.col("q"), F.col("vals"))))


def unpredictables(q, vals):
    """Values whose index is 0, in stream order."""
    return F.transform(F.filter(F.arrays_zip(q.alias("q"), vals.alias("v")), lambda s: s["q"] == 0),
                       lambda s: s["v"])


# ---------------------------------------------------------------- N-D chunks

def wavefront(shape: tuple[int, ...]) -> list[np.ndarray]:
    """Flat cell numbers grouped by coordinate sum: a cell depends on earlier groups only."""
    total = np.indices(shape).sum(axis=0).ravel()
    order = np.argsort(total, kind="stable")
    cuts = np.flatnonzero(np.diff(total[order])) + 1
    return np.split(order, cuts)


def lorenzo_terms(rank: int, layers: int, pred_dim: int | None = None) -> list[tuple[tuple[int, ...], float]]:
    """Offsets and weights of the predictor, i.e. 1 - prod over axes of (1 - shift)**L."""
    layers = 1 if rank == 4 else layers
    weights = {1: [1, -1], 2: [1, -2, 1]}[layers]
    used = range(rank - (pred_dim or rank), rank)
    terms = []
    for back in np.ndindex(*[layers + 1 if a in used else 1 for a in range(rank)]):
        if any(back):
            terms.append((back, -float(np.prod([weights[b] for b in back]))))
    return terms


def padded_index(shape: tuple[int, ...], pad: int) -> tuple[np.ndarray, tuple[int, ...]]:
    """Flat positions of an array's cells inside a copy with ``pad`` zero layers at the low sides."""
    big = tuple(s + pad for s in shape)
    return np.arange(np.prod(big)).reshape(big)[tuple(slice(pad, None) for _ in shape)].ravel(), big


def lorenzo_nd_step(data: np.ndarray, shape: tuple[int, ...], eb, radius: int, layers: int = 1,
                    pred_dim: int | None = None, forced: np.ndarray | None = None,
                    second: np.ndarray | None = None):
    """Closed-loop Lorenzo of ``data`` [chunks, cells]; returns indices and reconstructions.

    ``forced`` holds predictions that replace the stencil where not NaN (regression blocks) and
    ``second`` marks cells that use the two-layer stencil.
    """
    pad = 2
    where, big = padded_index(shape, pad)
    jump = [int(np.prod(big[a + 1:])) for a in range(len(big))]
    one = [(sum(b * j for b, j in zip(back, jump)), w) for back, w in lorenzo_terms(len(shape), layers, pred_dim)]
    two = [(sum(b * j for b, j in zip(back, jump)), w) for back, w in lorenzo_terms(len(shape), 2, pred_dim)]
    recon = np.zeros((len(data), int(np.prod(big))))
    q = np.zeros(data.shape, np.int32)
    bound = np.asarray(eb, dtype=np.float64).reshape(-1, 1)
    for cells in wavefront(shape):
        at = where[cells]
        pred = sum(w * recon[:, at - off] for off, w in one)
        if second is not None and second[:, cells].any():
            alt = sum(w * recon[:, at - off] for off, w in two)
            pred = np.where(second[:, cells], alt, pred)
        if forced is not None:
            pred = np.where(np.isnan(forced[:, cells]), pred, forced[:, cells])
        q[:, cells], recon[:, at] = quantize_step(data[:, cells], pred, bound, radius)
    return q, recon[:, where]


def lorenzo_nd_recover(q: np.ndarray, stored: np.ndarray, shape: tuple[int, ...], eb, radius: int,
                       layers: int = 1, pred_dim: int | None = None, forced: np.ndarray | None = None,
                       second: np.ndarray | None = None) -> np.ndarray:
    """Inverse of :func:`lorenzo_nd_step`; ``stored`` holds the raw value wherever the index is 0."""
    pad = 2
    where, big = padded_index(shape, pad)
    jump = [int(np.prod(big[a + 1:])) for a in range(len(big))]
    one = [(sum(b * j for b, j in zip(back, jump)), w) for back, w in lorenzo_terms(len(shape), layers, pred_dim)]
    two = [(sum(b * j for b, j in zip(back, jump)), w) for back, w in lorenzo_terms(len(shape), 2, pred_dim)]
    recon = np.zeros((len(q), int(np.prod(big))))
    bound = np.asarray(eb, dtype=np.float64).reshape(-1, 1)
    for cells in wavefront(shape):
        at = where[cells]
        pred = sum(w * recon[:, at - off] for off, w in one)
        if second is not None and second[:, cells].any():
            alt = sum(w * recon[:, at - off] for off, w in two)
            pred = np.where(second[:, cells], alt, pred)
        if forced is not None:
            pred = np.where(np.isnan(forced[:, cells]), pred, forced[:, cells])
        idx = q[:, cells]
        recon[:, at] = np.where(idx == 0, stored[:, cells], pred + 2 * (idx - radius) * bound)
    return recon[:, where]
