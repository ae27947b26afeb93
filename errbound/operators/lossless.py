"""Lossless byte stage: zstd at level 3, or bypass.

Arrow UDFs like the coders, so that coding and compressing a stream run in one Python pass.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL = 3


def shrink(raw: bytes, codec: str = "zstd") -> bytes:
    """One stream inside a Python pass."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw) if codec == "zstd" else raw


def restore(packed: bytes, codec: str = "zstd") -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if codec == "zstd" else packed


def compress(payload: str | Column, codec: str = "zstd") -> Column:
    @F.arrow_udf("binary")
    def zstd(raw: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        return pa.array([packer.compress(b) for b in raw.to_pylist()], pa.binary())

    return zstd(payload) if codec == "zstd" else F.col(payload) if isinstance(payload, str) else payload


def decompress(payload: str | Column, codec: str = "zstd") -> Column:
    @F.arrow_udf("binary")
    def unzstd(packed: pa.Array) -> pa.Array:
        unpacker = zstandard.ZstdDecompressor()
        return pa.array([unpacker.decompress(b) for b in packed.to_pylist()], pa.binary())

    return unzstd(payload) if codec == "zstd" else F.col(payload) if isinstance(payload, str) else payload
