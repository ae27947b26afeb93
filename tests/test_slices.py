"""Passes over chunks hold few of them at a time, whatever an Arrow batch brings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from errbound.config import Algorithm, Config
from errbound.operators.slices import VALUES, cuts
from errbound.operators import slices
from errbound.plans import array_codec as codec
from errbound.plans import md_codec as md
from errbound.plans import particle_codec as pc


def test_cuts_cover_all_rows_within_the_limit():
    sizes = np.array([3, 4, 5, 20, 1, 1, 9])
    parts = list(cuts(sizes, 9))
    assert parts == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert list(cuts(np.array([]), 9)) == []


@pytest.mark.parametrize("conf", [
    Config(dims=(64, 8, 8), algorithm=Algorithm.LORENZO_REG, regression2=True),
    Config(dims=(64, 8, 8), algorithm=Algorithm.LORENZO_REG, regression=False, pred_dim=2),
    Config(dims=(64, 8, 8), algorithm=Algorithm.INTERP),
])
def test_working_arrays_stay_small_and_all_chunks_come_back(spark, conf):
    """A batch of 200 chunks of 4,096 values is more than a slice; each prediction and each decoded slice sees a slice at most."""
    values = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda k: F.sin((F.col("id") * 7 + k) / 50.0))
    chunks = spark.range(0, 200, 1, 1).select(F.col("id").alias("chunk_id"), F.array(*[F.lit(0)] * 3).alias("origin"),
                                              F.array(F.lit(64), F.lit(8), F.lit(8)).alias("dims"), values.alias("vals"), F.lit(0.01).alias("eb"))
    packed = codec.compress(chunks, [], conf).cache()
    back = codec.decompress(packed, conf)
    both = chunks.join(back.select("chunk_id", "decoded"), "chunk_id")
    worst = F.array_max(F.zip_with("vals", "decoded", lambda a, b: F.abs(a - b)))
    assert both.agg(F.count(F.lit(1)), F.max(worst)).first()[0] == 200
    assert both.agg(F.max(worst)).first()[0] <= 0.01 * (1 + 1e-9)
    rows = [len(r) for _, _, r in codec.by_shape_and_name(*_shapes(200))]
    assert sum(rows) == 200 and max(rows) * 4096 <= VALUES


def _shapes(n):
    import pyarrow as pa
    return pa.array([[64, 8, 8]] * n), pa.array([""] * n)


def test_tiles_of_a_run_are_decoded_by_slices(spark, monkeypatch):
    """300 tiles of 1,000 values in one partition: a slice holds what the limit allows, and every value comes back."""
    seen = []

    def small(rows, schema, size, run):
        seen.append([r[size] for r in rows.collect()])
        return slices.by_slices(rows, schema, size, lambda b: _limited(b, run))

    def _limited(batch, run):
        if sum(batch.column("cells").to_pylist()) > VALUES:
            raise ValueError("a slice is too large")
        return run(batch)

    monkeypatch.setattr(md, "by_slices", small)
    rows = spark.range(0, 300_000, 1, 1).select(F.lit("x").alias("axis"), F.floor(F.col("id") / 100).alias("frame"),
                                                (F.col("id") % 100).alias("slot"), F.sin(F.col("id") / 9.0).alias("v"))
    packed = md.compress(rows, Config(dims=(10, 100), abs_bound=0.01), 10, md.LR, 128).coalesce(1).cache()
    assert dict(packed.dtypes)["q"] == "binary"
    back = md.decompress(packed, Config(dims=(10, 100), abs_bound=0.01)).withColumnRenamed("v", "d")
    worst = rows.join(back, ["axis", "frame", "slot"]).agg(F.count(F.lit(1)), F.max(F.abs(F.col("v") - F.col("d")))).first()
    assert seen == [[1000] * 300] and worst[0] == 300_000 and worst[1] <= 0.01 * (1 + 1e-9)


def test_cells_of_a_frame_are_decoded_by_slices(spark, monkeypatch):
    """Streams of chunks are decoded by slices whose number of cells is known before; every particle comes back."""
    seen = []

    def small(rows, schema, size, run):
        seen.append(sum(r[size] for r in rows.collect()))
        return slices.by_slices(rows, schema, size, run)

    monkeypatch.setattr(pc, "by_slices", small)
    pts = spark.range(0, 20_000, 1, 1).select(*[((F.col("id") * k) % 1009).cast("double").alias(a) for a, k in zip("xyz", (1, 31, 517))])
    packed = pc.compress_frames(pts, [], 0.25, 8)
    back = pc.decode_cells(packed, []).groupBy(*[F.round(a).alias(a) for a in "xyz"]).agg(F.sum("n").alias("n"))
    want = pts.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    assert want.exceptAll(back).count() == 0 and back.exceptAll(want).count() == 0 and seen == [want.count()]


def test_lists_of_a_batch_are_views():
    """Encoders see a batch's integers and doubles where they lie; a copy would double what a worker holds."""
    import pyarrow as pa

    from errbound.operators.closed_loop import _ragged
    from errbound.operators.encoders import _ragged_int

    doubles, ints = pa.array([[1.0, 2.0], [], [3.0]]), pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))
    for column, read in ((doubles, _ragged), (ints, _ragged_int)):
        flat, off = read(column.slice(0, 3))
        assert flat.tolist() == [1, 2, 3] and off.tolist() == [0, 2, 2, 3]
        assert np.shares_memory(flat, column.values.to_numpy())
        flat, off = read(column.slice(1, 2))
        assert flat.tolist() == [3] and off.tolist() == [0, 0, 1]


def test_key_frames_are_coded_before_they_are_read(spark):
    """Whoever decodes key frames reads stored rows: no worker that codes them runs beside the one that decodes them."""
    rows = spark.range(0, 4000, 1, 2).select((F.col("id") % 100).alias("pid"), F.floor(F.col("id") / 100).alias("frame"),
                                             *[((F.col("id") * k) % 1009).cast("double").alias(a) for a, k in zip("xyz", (1, 31, 517))])
    key_frames, batches, order = pc.compress_trajectory(rows, 0.25, 8, 4)
    assert "ArrowEvalPython" not in key_frames._jdf.queryExecution().toString()
    assert "Range" not in batches._jdf.queryExecution().toString()  # rows and their anchors are stored, not made again from the input
    back = pc.decompress_trajectory(key_frames, batches, 0.25).join(order, ["anchor", "position"])
    got = back.select("pid", (F.col("anchor") + F.col("step")).alias("frame"), *[F.round(a).alias(a) for a in "xyz"])
    assert rows.exceptAll(got).count() == 0 and got.count() == 4000
