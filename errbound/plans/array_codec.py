"""Array compression: cells -> chunks -> predict and quantize -> entropy code -> lossless.

A field is cut into chunks of bounded size; each is coded on its own, like the slabs of a parallel
run, with zero outside the chunk.  After the one shuffle that gathers chunks everything is map-only.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from errbound.config import Algorithm, Config, ErrorBoundMode, Interpolator, strides
from errbound.operators import block_codec as bc
from errbound.operators import encoders, interp, lossless, stats
from errbound.operators.closed_loop import _ragged, lorenzo_nd_recover, lorenzo_nd_step
from errbound.operators.slices import VALUES, by_slices

# Fixed value: chunks with fewer values than this are stored as they are.
MIN_VALUES = 20

CODED = "struct<q: array<int>, unpred: array<double>, side: binary>"
PACKED = "struct<payload: binary, unpred_bytes: binary, side: binary>"


def to_chunks(cells: DataFrame, keys: list[str], dims: list[int], edge: list[int], value: str = "v") -> DataFrame:
    """One row per cell (``keys, i0..``) to chunk rows with origin, extents and row-major values."""
    rank = len(dims)
    number = [F.floor(F.col(f"i{a}") / edge[a]) for a in range(rank)]
    counts = [math.ceil(n / e) for n, e in zip(dims, edge)]
    chunk = sum((number[a] * s for a, s in enumerate(strides(counts))), F.lit(0)).cast("bigint")
    extent = [F.least(F.lit(edge[a]), F.lit(dims[a]) - number[a] * edge[a]) for a in range(rank)]
    local = F.lit(0)
    for a in range(rank):
        local = local * extent[a] + (F.col(f"i{a}") - number[a] * edge[a])
    tagged = cells.select(*keys, chunk.alias("chunk_id"), local.cast("bigint").alias("_l"),
                          F.col(value).cast("double").alias("_v"),
                          F.array(*[(number[a] * edge[a]).cast("int") for a in range(rank)]).alias("origin"),
                          F.array(*[e.cast("int") for e in extent]).alias("dims"))
    return tagged.groupBy(*keys, "chunk_id").agg(
        F.first("origin").alias("origin"), F.first("dims").alias("dims"),
        F.transform(F.array_sort(F.collect_list(F.struct("_l", "_v"))), lambda s: s["_v"]).alias("vals"))


def slabs_to_chunks(rows: DataFrame, keys: list[str], inner: list[int], height: int) -> DataFrame:
    """Slab rows ``(keys, i0, row)`` to chunks of ``height`` slices; arrays travel whole."""
    number = F.floor(F.col("i0") / height)
    grouped = rows.groupBy(*keys, number.alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("i0", "row"))).alias("_s"))
    return grouped.select(
        *keys, "chunk_id", F.array((F.col("chunk_id") * height).cast("int"), *[F.lit(0)] * len(inner)).alias("origin"),
        F.array(F.size("_s"), *[F.lit(n) for n in inner]).alias("dims"),
        F.flatten(F.transform("_s", lambda s: s["row"])).alias("vals"))


def to_cells(chunks: DataFrame, keys: list[str], rank: int, cols: dict[str, str]) -> DataFrame:
    """Chunk rows back to one row per cell with global coordinates."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    flat = chunks.select(*keys, "origin", "dims", F.posexplode(zipped).alias("_l", "_e"))
    coords, rest = {}, F.col("_l")
    for a in range(rank - 1, -1, -1):
        d = F.col("dims")[a]
        coords[f"i{a}"] = (rest % d + F.col("origin")[a]).cast("bigint")
        rest = F.floor(rest / d)
    return flat.select(*keys, *[coords[f"i{a}"].alias(f"i{a}") for a in range(rank)],
                       *[F.col(f"_e.{s}").alias(d) for s, d in cols.items()])


def chunk_bounds(chunks: DataFrame, keys: list[str], conf: Config) -> DataFrame:
    """Attach the absolute bound ``eb``; relative modes need one aggregate over per-chunk extremes.

    Chunks that bring their own ``eb`` keep it.
    """
    if "eb" in chunks.columns:
        return chunks
    if conf.mode is ErrorBoundMode.ABS:
        return chunks.withColumn("eb", F.lit(float(conf.abs_bound)))
    finite = F.filter("vals", lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    facts = chunks.select(*keys, F.array_min(finite).alias("_lo"), F.array_max(finite).alias("_hi"),
                          F.size("vals").alias("_n")).groupBy(*keys).agg(
        (F.max("_hi") - F.min("_lo")).alias("_r"), F.sum("_n").alias("_n"))
    facts = facts.select(*keys, stats.resolve_bound(conf, F.col("_r"), F.col("_n")).alias("eb"))
    return chunks.join(facts, keys) if keys else chunks.crossJoin(F.broadcast(facts))


def _enabled(conf: Config) -> set[int]:
    pairs = ((conf.lorenzo, bc.LORENZO), (conf.lorenzo2, bc.LORENZO2), (conf.regression, bc.REGRESSION),
             (conf.regression2, bc.POLY))
    return {k for on, k in pairs if on} or {bc.LORENZO}


def _code_blocks(data, shape, eb, conf: Config):
    quadratic = conf.regression2
    edge = bc.effective_edge(len(shape), conf.block_size, quadratic)
    blocks = bc.layout(shape, edge, len(shape) == 3 and not quadratic, quadratic)
    pred_dim = conf.pred_dim if conf.pred_dim < len(shape) else None
    sid, fits = bc.choose(data, shape, blocks, eb, _enabled(conf), pred_dim)
    coded, rebuilt = bc.code_coefficients(sid, fits, len(shape), eb, edge)
    forced, second = bc.forced_predictions(sid, rebuilt, blocks, data.shape[1])
    q, recon = lorenzo_nd_step(data, shape, eb, conf.radius, 1, pred_dim, forced, second)
    sides = []
    for r in range(len(data)):
        parts = [encoders.smaller_pack(sid[r])]
        for kind in (bc.REGRESSION, bc.POLY):
            if kind in coded:
                used = sid[r] == kind
                qs = coded[kind][r][used]
                parts += [encoders.smaller_pack(qs.ravel()), rebuilt[kind][r][used][qs == 0].astype("<f8").tobytes()]
        sides.append(b"".join(struct.pack("<i", len(p)) + p for p in parts))
    return q, recon, sides


def _split(buf: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(buf):
        n = struct.unpack_from("<i", buf, at)[0]
        parts.append(buf[at + 4:at + 4 + n])
        at += 4 + n
    return parts


def _decode_blocks(q, stored, sides, shape, eb, conf: Config):
    quadratic = conf.regression2
    edge = bc.effective_edge(len(shape), conf.block_size, quadratic)
    blocks = bc.layout(shape, edge, len(shape) == 3 and not quadratic, quadratic)
    pred_dim = conf.pred_dim if conf.pred_dim < len(shape) else None
    sid = np.zeros((len(q), len(blocks)), np.int32)
    widths = {bc.REGRESSION: len(shape) + 1, bc.POLY: len(bc.monomials(len(shape)))}
    kinds = [k for k in (bc.REGRESSION, bc.POLY) if k in _enabled(conf)
             and any((min(b.shape) > 1) if k == bc.REGRESSION else b.quadratic is not None for b in blocks)]
    rebuilt = {k: np.zeros((len(q), len(blocks), widths[k])) for k in kinds}
    for r, side in enumerate(sides):
        parts = _split(side)
        sid[r] = encoders.smaller_unpack(parts[0])
        for turn, kind in enumerate(kinds):
            idx = encoders.smaller_unpack(parts[1 + 2 * turn]).reshape(-1, widths[kind])
            raw = iter(np.frombuffer(parts[2 + 2 * turn], "<f8"))
            ebs = bc.coefficient_ebs(kind, len(shape), eb[r:r + 1], edge)[0]
            prev = np.zeros(widths[kind])
            for k, row in zip(np.flatnonzero(sid[r] == kind), idx):
                prev = np.array([next(raw) if i == 0 else p + 2 * (i - bc.COEFFICIENT_RADIUS) * e
                                 for i, p, e in zip(row, prev, ebs)])
                rebuilt[kind][r, k] = prev
    forced, second = bc.forced_predictions(sid, rebuilt, blocks, q.shape[1])
    return lorenzo_nd_recover(q, stored, shape, eb, conf.radius, 1, pred_dim, forced, second)


def _predict(data, shape, eb, conf: Config):
    if conf.algorithm is Algorithm.LORENZO_REG:
        return _code_blocks(data, shape, eb, conf)
    kind = "linear" if conf.interpolator is Interpolator.LINEAR else "cubic"
    q, recon = interp.sweep(data, shape, eb, conf.radius, kind, conf.interp_direction,
                            conf.interp_block_size or None)
    return q, recon, [b""] * len(data)


def quantized(confs: dict[str, Config], choice: Column) -> Column:
    """Struct (q, unpred, side) of a chunk; ``choice`` names the row's configuration.

    One UDF serves every candidate, so mixed choices stay in one pass over the chunks.
    """
    @F.arrow_udf(CODED)
    def run(vals: pa.Array, dims: pa.Array, eb: pa.Array, names: pa.Array) -> pa.Array:
        flat, off = _ragged(vals)
        bound = eb.to_numpy(zero_copy_only=False).astype(np.float64)
        out: list[dict] = [{}] * len(bound)
        for shape, name, rows in by_shape_and_name(dims, names):
            data = np.stack([flat[off[r]:off[r + 1]] for r in rows])
            q, _, side = _predict(data, shape, bound[rows], confs[name])
            for k, r in enumerate(rows):
                out[r] = {"q": q[k], "unpred": data[k][q[k] == 0], "side": side[k]}
        return pa.array(out, pa.struct([("q", pa.list_(pa.int32())), ("unpred", pa.list_(pa.float64())),
                                        ("side", pa.binary())]))

    return run("vals", "dims", "eb", choice)


def by_shape_and_name(dims: pa.Array, names: pa.Array) -> list[tuple[tuple, str, np.ndarray]]:
    """Rows of one shape and configuration, few enough at a time that working arrays stay bounded."""
    groups: dict[tuple, list[int]] = {}
    for i, (d, name) in enumerate(zip(dims.to_pylist(), names.to_pylist())):
        groups.setdefault((tuple(d), name), []).append(i)
    parts = []
    for (shape, name), rows in groups.items():
        few = max(VALUES // math.prod(shape), 1)
        parts += [(shape, name, np.array(rows[k:k + few])) for k in range(0, len(rows), few)]
    return parts


def packed_chunks(confs: dict[str, Config], choice: Column, conf: Config) -> Column:
    """Struct (payload, unpred_bytes, side) of a chunk: what :func:`coded_columns` makes of :func:`quantized`, in one pass of one worker."""
    encode, dtype = encoders.coder(_coder(conf))[0], _element(conf)

    @F.arrow_udf(PACKED)
    def run(vals: pa.Array, dims: pa.Array, eb: pa.Array, names: pa.Array) -> pa.Array:
        flat, off = _ragged(vals)
        bound = eb.to_numpy(zero_copy_only=False).astype(np.float64)
        out: list[dict] = [{}] * len(bound)
        for shape, name, rows in by_shape_and_name(dims, names):
            data = np.stack([flat[off[r]:off[r + 1]] for r in rows])
            q, _, side = _predict(data, shape, bound[rows], confs[name])
            for k, r in enumerate(rows):
                out[r] = {"payload": lossless.shrink(encode(q[k].astype(np.int64)), conf.lossless),
                          "unpred_bytes": lossless.shrink(data[k][q[k] == 0].astype(dtype).tobytes()), "side": lossless.shrink(side[k])}
        return pa.array(out, pa.struct([(n, pa.binary()) for n in ("payload", "unpred_bytes", "side")]))

    return run("vals", "dims", "eb", choice)


def _unpacked(confs: dict[str, Config], conf: Config, named: bool):
    """Batches of container rows to batches of decoded chunks, without the bytes."""
    decode, dtype = encoders.coder(_coder(conf))[1], _element(conf)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column("choice") if named else pa.array([""] * len(batch))
        payload, stored_bytes, sides = (batch.column(n).to_pylist() for n in ("payload", "unpred_bytes", "side"))
        bound = batch.column("eb").to_numpy(zero_copy_only=False).astype(np.float64)
        out: list = [None] * len(batch)
        for shape, name, rows in by_shape_and_name(batch.column("dims"), names):
            one = confs[name]
            qs = np.stack([decode(lossless.restore(payload[r], conf.lossless)) for r in rows])
            stored = np.zeros(qs.shape)
            for k, r in enumerate(rows):
                stored[k][qs[k] == 0] = np.frombuffer(lossless.restore(stored_bytes[r]), dtype)
            if one.algorithm is Algorithm.LORENZO_REG:
                back = _decode_blocks(qs, stored, [lossless.restore(sides[r]) for r in rows], shape, bound[rows], one)
            else:
                kind = "linear" if one.interpolator is Interpolator.LINEAR else "cubic"
                back = interp.unsweep(qs, stored, shape, bound[rows], one.radius, kind,
                                      one.interp_direction, one.interp_block_size or None)
            for k, r in enumerate(rows):
                out[r] = back[k]
        left = {n: batch.column(n) for n in batch.schema.names if n not in ("payload", "unpred_bytes", "side")}
        return pa.RecordBatch.from_pydict(left | {"decoded": pa.array(out, pa.list_(pa.float64()))})

    return run


def _doubles(col: str | Column, dtype: str) -> Column:
    @F.arrow_udf("binary")
    def run(vals: pa.Array) -> pa.Array:
        flat, off = _ragged(vals)
        return pa.array([flat[a:b].astype(dtype).tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())
    return run(col)


def _from_doubles(col: str | Column, dtype: str) -> Column:
    @F.arrow_udf("array<double>")
    def run(raw: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b, dtype).astype(np.float64) for b in raw.to_pylist()], pa.list_(pa.float64()))
    return run(col)


def _truncated(col: str, keep: int) -> Column:
    @F.arrow_udf("binary")
    def run(vals: pa.Array) -> pa.Array:
        flat, off = _ragged(vals)
        top = flat.astype("<f4").view(np.uint8).reshape(-1, 4)[:, 4 - keep:]
        return pa.array([top[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())
    return run(col)


def _untruncated(col: str, keep: int) -> Column:
    @F.arrow_udf("array<double>")
    def run(raw: pa.Array) -> pa.Array:
        out = []
        for b in raw.to_pylist():
            whole = np.zeros((len(b) // keep, 4), np.uint8)
            whole[:, 4 - keep:] = np.frombuffer(b, np.uint8).reshape(-1, keep)
            out.append(whole.view("<f4").ravel().astype(np.float64))
        return pa.array(out, pa.list_(pa.float64()))
    return run(col)


def _element(conf: Config) -> str:
    return "<f4" if conf.element_type == "float32" else "<f8"


def _coder(conf: Config) -> str:
    return "auto" if conf.encoder == "huffman" else conf.encoder


def coded_columns(struct_col: str, conf: Config) -> dict[str, Column]:
    """Bytes of one quantized chunk: indices, stored values, side information."""
    s = F.col(struct_col)
    return {
        "payload": lossless.compress(encoders.pack(s["q"], _coder(conf)), conf.lossless),
        "unpred_bytes": lossless.compress(_doubles(s["unpred"], _element(conf))),
        "side": lossless.compress(s["side"]),
    }


def compress(chunks: DataFrame, keys: list[str], conf: Config, options: dict[str, Config] | None = None) -> DataFrame:
    """Chunk rows to a container: ``keys, chunk_id, origin, dims, n, algo, eb, payload, unpred_bytes, side``.

    A zero bound and tiny chunks are stored losslessly; truncation keeps ``extra['keep_bytes']`` bytes.
    With ``options`` each row's ``choice`` column names its configuration and stays in the container.
    """
    kept = [*keys, "chunk_id", "origin", "dims", "n", "eb"] + (["choice"] if options else [])
    sized = chunks.withColumn("n", F.size("vals"))

    def stored(rows: DataFrame, algo: str, payload: Column) -> DataFrame:
        return rows.select(*kept, F.lit(algo).alias("algo"), payload.alias("payload"),
                           F.lit(b"").alias("unpred_bytes"), F.lit(b"").alias("side"))

    if conf.algorithm is Algorithm.TRUNCATE:
        return stored(sized.withColumn("eb", F.lit(0.0)), conf.algorithm.value,
                      lossless.compress(_truncated("vals", conf.extra["keep_bytes"])))
    bounded = chunk_bounds(sized, keys, conf)
    as_is = lossless.compress(_doubles("vals", _element(conf)))
    if conf.algorithm is Algorithm.LOSSLESS:
        return stored(bounded, Algorithm.LOSSLESS.value, as_is)
    tiny = (F.col("n") < MIN_VALUES) | (F.col("eb") <= 0)
    choice = F.col("choice") if options else F.lit("")
    coded = bounded.where(~tiny).withColumn("_c", packed_chunks(options or {"": conf}, choice, conf))
    packed = coded.select(*kept, F.lit(conf.algorithm.value).alias("algo"), "_c.*")
    return packed.unionByName(stored(bounded.where(tiny), Algorithm.LOSSLESS.value, as_is))


def decompress(container: DataFrame, conf: Config, options: dict[str, Config] | None = None) -> DataFrame:
    """Container rows back to chunk rows with ``decoded`` values."""
    keep = [c for c in container.columns if c not in ("payload", "unpred_bytes", "side")]
    if conf.algorithm is Algorithm.TRUNCATE:
        return container.select(*keep, _untruncated(lossless.decompress("payload"), conf.extra["keep_bytes"]).alias("decoded"))
    raw = container.where(F.col("algo") == Algorithm.LOSSLESS.value).select(
        *keep, _from_doubles(lossless.decompress("payload"), _element(conf)).alias("decoded"))
    if conf.algorithm is Algorithm.LOSSLESS:
        return raw
    coded = container.where(F.col("algo") == conf.algorithm.value).select(*keep, "payload", "unpred_bytes", "side")
    schema = StructType([*[coded.schema[c] for c in keep], StructField("decoded", ArrayType(DoubleType()))])
    return by_slices(coded, schema, "n", _unpacked(options or {"": conf}, conf, bool(options))).unionByName(raw)


def packed_bytes() -> Column:
    """Stored size of one container row."""
    return F.octet_length("payload") + F.octet_length("unpred_bytes") + F.octet_length("side")
