"""Headerless binary arrays as a Spark data source: ``format("rawbinary")``.

Reading splits files by byte range, so a task opens only its own part.  Several equally long files can
be read side by side as columns.  Writing seeks each value to its own offset, so tasks write in parallel
and a repeated task writes the same bytes again.  Paths must be visible to all executors.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from errbound.config import ELEMENT_TYPES

ROWS_PER_BATCH = 1 << 16
ROWS_PER_PARTITION = 1 << 24
# Unsigned values widen to the next signed Arrow type; 64-bit ones to decimals.
WIDENED = {"uint8": "int16", "uint16": "int32", "uint32": "int64"}


class Range(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))
        self.first, self.count = first, count


class RawReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str], dtype: str, offset: int, limit: int | None, step: int):
        self.paths, self.names, self.dtype = paths, names, dtype
        self.offset, self.limit, self.step = offset, limit, step

    def partitions(self):
        size = np.dtype(self.dtype).itemsize
        lengths = {os.path.getsize(p) // size for p in self.paths}
        if len(lengths) != 1:
            raise ValueError(f"files differ in length: {sorted(lengths)}")
        total = lengths.pop() - self.offset
        if self.limit is not None:
            if self.limit > total:
                raise ValueError(f"asked for {self.limit} values, {total} there")
            total = self.limit
        return [Range(at, min(self.step, total - at)) for at in range(0, total, self.step)]

    def read(self, part):
        size = np.dtype(self.dtype).itemsize
        files = [open(p, "rb") for p in self.paths]
        try:
            for f in files:
                f.seek((self.offset + part.first) * size)
            for at in range(0, part.count, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, part.count - at)
                first = part.first + at
                columns = [pa.array(np.arange(first, first + n))]
                columns += [_arrow(np.frombuffer(f.read(n * size), np.dtype(self.dtype).newbyteorder("<")), self.dtype)
                            for f in files]
                yield pa.RecordBatch.from_arrays(columns, ["idx", *self.names])
        finally:
            for f in files:
                f.close()


def _arrow(values: np.ndarray, dtype: str) -> pa.Array:
    if dtype == "uint64":
        from decimal import Decimal
        return pa.array([Decimal(int(v)) for v in values], pa.decimal128(20, 0))
    return pa.array(values.astype(WIDENED.get(dtype, dtype)))


@dataclass
class Written(WriterCommitMessage):
    end: int


class RawWriter(DataSourceArrowWriter):
    """Writes values at their positions; an overwritten file ends after the last of them."""

    def __init__(self, path: str, dtype: str, overwrite: bool = False):
        self.path, self.dtype, self.overwrite = path, dtype, overwrite

    def commit(self, messages):
        if self.overwrite:
            os.truncate(self.path, max((m.end for m in messages if m), default=0))

    def write(self, batches):
        size, end = np.dtype(self.dtype).itemsize, 0
        fd = os.open(self.path, os.O_RDWR | os.O_CREAT)
        try:
            for batch in batches:
                idx = batch.column("idx").to_numpy(zero_copy_only=False)
                values = np.array(batch.column("v").to_pylist(), self.dtype) if self.dtype == "uint64" else \
                    batch.column("v").to_numpy(zero_copy_only=False).astype(np.dtype(self.dtype).newbyteorder("<"))
                order = np.argsort(idx, kind="stable")
                idx, values = idx[order], values[order]
                # Consecutive positions go out in one write.
                cuts = np.flatnonzero(np.diff(idx) != 1) + 1
                for run, where in zip(np.split(values, cuts), np.split(idx, cuts)):
                    if len(run):
                        os.pwrite(fd, run.tobytes(), int(where[0]) * size)
                        end = max(end, (int(where[-1]) + 1) * size)
        finally:
            os.close(fd)
        return Written(end)


class RawBinary(DataSource):
    @classmethod
    def name(cls):
        return "rawbinary"

    def _paths(self):
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def _names(self):
        return json.loads(self.options["names"]) if "names" in self.options else ["v"]

    def schema(self):
        kind = ELEMENT_TYPES[self.options.get("dtype", "float32")]
        return T.StructType([T.StructField("idx", T.LongType())] + [T.StructField(n, kind) for n in self._names()])

    def reader(self, schema):
        limit = self.options.get("limit")
        return RawReader(self._paths(), self._names(), self.options.get("dtype", "float32"),
                         int(self.options.get("offset", 0)), None if limit is None else int(limit),
                         int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION)))

    def writer(self, schema, overwrite):
        return RawWriter(self.options["path"], self.options.get("dtype", "float32"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawBinary)


def read_raw(spark: SparkSession, path: str, dtype: str = "float32", offset: int = 0,
             limit: int | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``idx, v`` of a raw file; ``offset`` and ``limit`` count values."""
    register(spark)
    reader = spark.read.format("rawbinary").option("path", path).option("dtype", dtype).option(
        "offset", offset).option("rowsPerPartition", rows_per_partition)
    return (reader if limit is None else reader.option("limit", limit)).load()


def read_raw_columns(spark: SparkSession, paths: dict[str, str], dtype: str = "float32",
                     rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Equally long files side by side: ``idx`` plus one column per file, without a join."""
    register(spark)
    return (spark.read.format("rawbinary").option("paths", json.dumps(list(paths.values())))
            .option("names", json.dumps(list(paths))).option("dtype", dtype)
            .option("rowsPerPartition", rows_per_partition).load())


def write_raw(df: DataFrame, path: str, dtype: str = "float32") -> None:
    """``idx, v`` to one raw file.  Range partitioning keeps each task's writes contiguous."""
    register(df.sparkSession)
    (df.select("idx", "v").repartitionByRange("idx").sortWithinPartitions("idx")
     .write.format("rawbinary").option("path", path).option("dtype", dtype).mode("overwrite").save())
