"""Shared folders, stored tables and file access for executors."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Arrow batches of stored tables, unless the session names a limit of its own: as long as texts are, rows alone do not bound them.
BATCH_BYTES = 4 << 20
#: What each operator's tasks keep in a worker process.
_caches: dict[str, list] = {}


@lru_cache(maxsize=1)
def serve(operator: str) -> None:
    """Tasks of another operator than before begin: a reused worker gives up what it kept, so that it never holds the tables of all stages."""
    for other, caches in _caches.items():
        if other != operator:
            for cache in caches:
                cache.cache_clear()
    gc.collect()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def kept_for(operator: str, size: int):
    """Keep a function's last results in the worker process while it serves this operator."""
    def wrap(make):
        @lru_cache(maxsize=size)
        @wraps(make)
        def get(*args):
            serve(operator)
            return make(*args)

        _caches.setdefault(operator, []).append(get)
        return get
    return wrap


@contextmanager
def bounded_batches(spark: SparkSession):
    """Arrow batches of what is run meanwhile have at most BATCH_BYTES, if the session sets no limit."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is not None:
        yield
        return
    conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        conf.unset(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a single-process session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="errbound-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and is computed once."""
    path = fresh_dir(df.sparkSession, tag)
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file, on the driver or an executor."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def small_batches(batches, rows: int = 512):
    """Cut Arrow batches, so that only a few texts at a time become Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def text_slices(texts: list, limit: int = 600_000):
    """Cut a list of texts into runs (first, last) of about `limit` characters."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
