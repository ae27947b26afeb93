"""Symbol coding: histograms and code sizes in SQL, bit packing per chunk in Arrow batches.

A chunk row carries its own symbols, so packing and unpacking are map-only: no codebook is shipped
between tasks and each chunk decodes on its own.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errbound.functions.scalars import fixed_width
from errbound.operators.ordering import running_sum, with_neighbours

# Limits of the arithmetic coder's frequency table.
ARITH_MAX_TOTAL = 1 << 20
ARITH_MAX_STATES = 4096
ARITH_BITS = 44

# An alphabet above this size is coded with fixed-length codes, which need no table.
HUFFMAN_MAX_ALPHABET = 1 << 17


# ------------------------------------------------------------------ SQL side

def histogram(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Symbol frequencies; map-side partial counts make a dominant symbol harmless."""
    return df.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("freq"))


def entropy_bits(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon size of the coded stream from its histogram, the proxy for a Huffman size.

    ``sum f*log2(n/f) = n*log2(n) - sum f*log2(f)``: one aggregation, no window over the alphabet.
    """
    f = F.col("freq")
    agg = hist.groupBy(*keys).agg(F.sum(f).alias("n"), F.count(F.lit(1)).alias("symbols"),
                                  F.sum(f * F.log2(f)).alias("_fl"))
    return agg.select(*keys, "n", "symbols", (F.col("n") * F.log2("n") - F.col("_fl")).alias("bits"))


def fixed_bits(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Size of fixed-length coding: n times the width of the symbol span."""
    agg = df.groupBy(*keys).agg(F.count(symbol).alias("n"), F.min(symbol).alias("lo"), F.max(symbol).alias("hi"))
    width = fixed_width(F.col("hi") - F.col("lo") + 1)
    return agg.select(*keys, "n", width.alias("width"), (F.col("n") * width).alias("bits"))


def cumulative_frequencies(hist: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Frequency table of the arithmetic coder: running [low, high) per state in symbol order.

    Totals above 2**20 are scaled down, never to zero.  More than 4096 states per key is an error, so
    the windows below stay small.
    """
    states = hist.groupBy(*keys).agg(F.assert_true(
        F.count(F.lit(1)) <= ARITH_MAX_STATES, "arithmetic coding takes at most 4096 states").alias("_ok"))
    hist = (hist.join(states, keys) if keys else hist.crossJoin(F.broadcast(states))).where("_ok IS NULL").drop("_ok")
    whole = Window.partitionBy(*keys)
    n = F.sum("freq").over(whole)
    step = F.when(n <= ARITH_MAX_TOTAL, F.lit(1)).otherwise(
        F.ceil(n / F.lit(ARITH_MAX_TOTAL))).cast("bigint")
    scaled = hist.withColumn("_f", F.greatest(F.lit(1), F.floor(F.col("freq") / step)))
    w = whole.orderBy(symbol).rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn("high", F.sum("_f").over(w)).withColumn(
        "low", F.col("high") - F.col("_f")).drop("_f")


def run_lengths(df: DataFrame, keys: list[str], pos: str, symbol: str, tile: int = 1 << 16) -> DataFrame:
    """Run-length coding along ``pos``: one row per run with start, value and count.

    Starts are found against the tiled neighbour, run numbers by a stitched running sum, and counts by
    a hash aggregation, so one run may span the whole data set.
    """
    marked = with_neighbours(df.select(*keys, pos, symbol), keys, pos, [symbol], before=1, tile=tile)
    marked = marked.withColumn("_new", (~F.col(symbol).eqNullSafe(F.col(f"{symbol}_m1"))
                                        | (F.col(pos) == 0)).cast("bigint"))
    numbered = running_sum(marked, keys, pos, {"_new": "run_id"}, tile)
    return numbered.groupBy(*keys, "run_id").agg(
        F.min(pos).alias("run_start"), F.first(symbol).alias(symbol), F.count(F.lit(1)).alias("run_length"))


# ------------------------------------------------------------- chunk packing

def huffman_lengths(freqs: np.ndarray) -> np.ndarray:
    """Code length per symbol of a Huffman tree; ties go to the node made first."""
    if len(freqs) == 1:
        return np.zeros(1, np.int64)
    heap = [(int(f), i) for i, f in enumerate(freqs)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(freqs) - 1, np.int64)
    for node in range(len(freqs), len(parent)):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = node
        heapq.heappush(heap, (a[0] + b[0], node))
    depth = np.zeros(len(parent), np.int64)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[:len(freqs)]


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of the symbols and their code words, shortest first."""
    order = np.argsort(lengths, kind="stable")
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for rank, k in enumerate(order):
        length = int(lengths[k])
        code = (code + 1) << (length - last) if rank else 0
        codes[k], last = code, length
    return order, codes


def _pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Concatenate code words of the given widths, most significant bit first."""
    total = int(widths.sum())
    if not total:
        return b""
    ends = np.cumsum(widths)
    owner = np.repeat(np.arange(len(values)), widths)
    back = (ends[owner] - 1 - np.arange(total)).astype(np.uint64)
    return np.packbits((values.astype(np.uint64)[owner] >> back & np.uint64(1)).astype(np.uint8)).tobytes()


def huffman_pack(symbols: np.ndarray) -> bytes:
    """Self-contained Huffman stream: count, alphabet, code lengths, code words."""
    alphabet, inverse, freqs = np.unique(symbols.astype(np.int64), return_inverse=True, return_counts=True)
    head = struct.pack("<qi", len(symbols), len(alphabet))
    if not len(symbols):
        return head
    lengths = huffman_lengths(freqs)
    _, codes = canonical_codes(lengths)
    return (head + alphabet.astype("<i8").tobytes() + lengths.astype(np.uint8).tobytes()
            + _pack_bits(codes[inverse], lengths[inverse]))


def huffman_unpack(buf: bytes) -> np.ndarray:
    """Decode by walking all bit offsets at once.

    Every bit offset gets the symbol that would start there, then jumps are followed by doubling, so the
    sequential part is logarithmic.
    """
    n, k = struct.unpack_from("<qi", buf)
    if not n:
        return np.zeros(0, np.int64)
    at = 12
    alphabet = np.frombuffer(buf, "<i8", k, at)
    lengths = np.frombuffer(buf, np.uint8, k, at + 8 * k).astype(np.int64)
    if k == 1:
        return np.full(n, alphabet[0])
    order, codes = canonical_codes(lengths)
    bits = np.unpackbits(np.frombuffer(buf, np.uint8, offset=at + 9 * k))
    depth = int(lengths.max())
    padded = np.concatenate([bits, np.zeros(depth, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(bits), np.uint64)
    for d in range(depth):
        window = (window << np.uint64(1)) | padded[d:d + len(bits)]
    # Canonical code words, left-aligned, are sorted: the word that starts here is a binary search.
    aligned = codes[order] << (depth - lengths[order]).astype(np.uint64)
    hit = order[np.searchsorted(aligned, window, side="right") - 1]
    return alphabet[hit[_follow(lengths[hit], n)]]


def _follow(jump: np.ndarray, n: int) -> np.ndarray:
    """Offsets 0, jump[0], ... : the first ``n`` stops, found by pointer doubling."""
    end = len(jump)
    nxt = np.minimum(np.append(np.arange(end) + jump, end), end)
    stops, hop = np.zeros(1, np.int64), nxt
    while len(stops) < n:
        stops = np.concatenate([stops, hop[stops]])
        hop = hop[hop]
    return stops[:n]


def fixed_pack(symbols: np.ndarray) -> bytes:
    symbols = symbols.astype(np.int64)
    lo = int(symbols.min()) if len(symbols) else 0
    span = int(symbols.max()) - lo + 1 if len(symbols) else 1
    width = max(1, (span - 1).bit_length())
    body = _pack_bits((symbols - lo).astype(np.uint64), np.full(len(symbols), width))
    return struct.pack("<qqB", len(symbols), lo, width) + body


def fixed_unpack(buf: bytes) -> np.ndarray:
    n, lo, width = struct.unpack_from("<qqB", buf)
    bits = np.unpackbits(np.frombuffer(buf, np.uint8, offset=17))[:n * width].reshape(n, width)
    out = np.zeros(n, np.uint64)
    for b in range(width):
        out = (out << np.uint64(1)) | bits[:, b]
    return out.astype(np.int64) + lo


def smaller_pack(symbols: np.ndarray) -> bytes:
    """Huffman or fixed-length, whichever is smaller; the first byte says which."""
    fixed = b"\x01" + fixed_pack(symbols)
    if len(np.unique(symbols)) > HUFFMAN_MAX_ALPHABET:
        return fixed
    huff = b"\x00" + huffman_pack(symbols)
    return huff if len(huff) < len(fixed) else fixed


def smaller_unpack(buf: bytes) -> np.ndarray:
    return (fixed_unpack if buf[0] else huffman_unpack)(buf[1:])


def bypass_pack(symbols: np.ndarray) -> bytes:
    """One byte per symbol; only for alphabets inside 0..255."""
    if len(symbols) and (symbols.min() < 0 or symbols.max() > 255):
        raise ValueError("bypass coding needs symbols in 0..255")
    return symbols.astype(np.uint8).tobytes()


def arith_table(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States in use and their cumulative frequencies (len + 1), scaled to at most 2**20."""
    states, freqs = np.unique(symbols, return_counts=True)
    if len(states) > ARITH_MAX_STATES:
        raise ValueError("arithmetic coding takes at most 4096 states")
    n = int(freqs.sum())
    if n > ARITH_MAX_TOTAL:
        freqs = np.maximum(1, freqs // -(-n // ARITH_MAX_TOTAL))
    return states, np.concatenate([[0], np.cumsum(freqs)]).astype(np.int64)


def arith_pack(symbols: np.ndarray) -> bytes:
    """Arithmetic coding of one chunk with exact integers: narrow [low, low+span) per symbol."""
    states, cum = arith_table(symbols)
    total = int(cum[-1]) if len(cum) > 1 else 1
    one, half, quarter = 1 << ARITH_BITS, 1 << (ARITH_BITS - 1), 1 << (ARITH_BITS - 2)
    low, high, pending, bits = 0, one - 1, 0, []
    which = np.searchsorted(states, symbols)
    edges = cum.tolist()
    for k in which.tolist():
        span = high - low + 1
        low, high = low + span * edges[k] // total, low + span * edges[k + 1] // total - 1
        while True:
            if high < half:
                bits.append(0)
                bits.extend([1] * pending)
                pending = 0
            elif low >= half:
                bits.append(1)
                bits.extend([0] * pending)
                pending = 0
                low, high = low - half, high - half
            elif low >= quarter and high < 3 * quarter:
                pending += 1
                low, high = low - quarter, high - quarter
            else:
                break
            low, high = 2 * low, 2 * high + 1
    tail = 0 if low < quarter else 1
    bits.extend([tail] + [1 - tail] * (pending + 1))
    return (struct.pack("<qi", len(symbols), len(states)) + states.astype("<i8").tobytes()
            + cum.astype("<i8").tobytes() + np.packbits(np.array(bits, np.uint8)).tobytes())


def arith_unpack(buf: bytes) -> np.ndarray:
    n, k = struct.unpack_from("<qi", buf)
    states = np.frombuffer(buf, "<i8", k, 12)
    cum = np.frombuffer(buf, "<i8", k + 1, 12 + 8 * k)
    bits = iter(np.unpackbits(np.frombuffer(buf, np.uint8, offset=20 + 16 * k)).tolist())
    total = int(cum[-1]) or 1
    one, half, quarter = 1 << ARITH_BITS, 1 << (ARITH_BITS - 1), 1 << (ARITH_BITS - 2)
    low, high, code = 0, one - 1, 0
    for _ in range(ARITH_BITS):
        code = 2 * code + next(bits, 0)
    edges, out = cum.tolist(), np.zeros(n, np.int64)
    for i in range(n):
        span = high - low + 1
        target = ((code - low + 1) * total - 1) // span
        s = int(np.searchsorted(cum, target, side="right")) - 1
        out[i] = states[s]
        low, high = low + span * edges[s] // total, low + span * edges[s + 1] // total - 1
        while True:
            if high < half:
                shift = 0
            elif low >= half:
                shift = half
            elif low >= quarter and high < 3 * quarter:
                shift = quarter
            else:
                break
            low, high, code = 2 * (low - shift), 2 * (high - shift) + 1, 2 * (code - shift) + next(bits, 0)
    return out


_CODERS = {
    "huffman": (huffman_pack, huffman_unpack),
    "fixed": (fixed_pack, fixed_unpack),
    "auto": (smaller_pack, smaller_unpack),
    "arithmetic": (arith_pack, arith_unpack),
    "bypass": (bypass_pack, lambda b: np.frombuffer(b, np.uint8).astype(np.int64)),
}


def coder(name: str) -> tuple:
    """The two functions of a coder: integers to bytes and back."""
    return _CODERS[name]


def pack(symbols: str | Column, coder: str = "huffman") -> Column:
    """Array of integers to a self-contained BINARY stream."""
    encode = _CODERS[coder][0]

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        flat, off = _ragged_int(col)
        return pa.array([encode(flat[a:b].astype(np.int64)) for a, b in zip(off[:-1], off[1:])], pa.binary())

    return run(symbols)


def unpack(payload: str | Column, coder: str = "huffman") -> Column:
    decode = _CODERS[coder][1]

    @F.arrow_udf("array<bigint>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([decode(b) for b in col.to_pylist()], pa.list_(pa.int64()))

    return run(payload)


def _ragged_int(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat integers of an Arrow list column and its offsets: a view of the batch in its own integer type, not a copy."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    off = arr.offsets.to_numpy().astype(np.int64)
    return arr.flatten().to_numpy(zero_copy_only=False), off - off[0]


def huffman_code_lengths(hist: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Code length per symbol.

    A key whose alphabet exceeds the table limit gets fixed-length codes instead, so the gathered
    alphabets are bounded whatever the symbols are.
    """
    @F.pandas_udf("array<int>")
    def lengths(freqs: pd.Series) -> pd.Series:
        return freqs.map(lambda f: huffman_lengths(np.asarray(f, np.int64)).astype(np.int32))

    facts = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.min(symbol).alias("_lo"), F.max(symbol).alias("_hi"))
    tagged = hist.join(facts, keys) if keys else hist.crossJoin(F.broadcast(facts))
    small = tagged.where(F.col("_k") <= HUFFMAN_MAX_ALPHABET)
    tables = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(symbol, "freq"))).alias("_t"))
    coded = tables.withColumn("_l", lengths(F.transform("_t", lambda s: s["freq"])))
    flat = coded.select(*keys, F.explode(F.arrays_zip(F.col("_t").alias("t"), F.col("_l").alias("l"))).alias("_e"))
    huffman = flat.select(*keys, F.col(f"_e.t.{symbol}").alias(symbol), F.col("_e.t.freq").alias("freq"),
                          F.col("_e.l").alias("code_length"))
    large = tagged.where(F.col("_k") > HUFFMAN_MAX_ALPHABET).select(
        *keys, symbol, "freq", fixed_width(F.col("_hi") - F.col("_lo") + 1).alias("code_length"))
    return huffman.unionByName(large)
