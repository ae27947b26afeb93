"""Python passes over chunk rows that hold few chunks at a time.

Compressed chunks are small rows, so an Arrow batch of them may decode into gigabytes.  Passes here take a batch slice by slice,
each of a bounded number of values, and decoded slices leave the worker one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Values that a slice may hold; a single larger chunk is a slice of its own.
VALUES = 1 << 18


def cuts(sizes: np.ndarray, limit: int = VALUES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum up to at most ``limit``."""
    start, held = 0, 0
    for row, size in enumerate(np.asarray(sizes).tolist()):
        if row > start and held + size > limit:
            yield start, row
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def by_slices(rows: DataFrame, schema: StructType | str, size: str, run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``run`` over slices of the rows, without a shuffle; the column ``size`` is the number of values of a row."""
    def go(batches):
        for batch in batches:
            for a, b in cuts(batch.column(size).to_numpy(zero_copy_only=False)):
                yield run(batch.slice(a, b - a))

    return rows.mapInArrow(go, schema)
