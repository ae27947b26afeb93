"""Codecs on the analytic smoke fields and on edge fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from errbound.config import Algorithm, Config, ErrorBoundMode, Interpolator
from errbound.plans import array_codec as codec
from errbound.plans import md_codec as md
from errbound.plans import particle_codec as pc
from errbound.plans import tuner


def smoke_field(spark, dims):
    """1e-4*y*sin(y) + 5e-4*cos(x*x+x) + z with coordinates centred on half of each extent."""
    a, b, c = dims
    i = F.col("id")
    cells = spark.range(a * b * c).select(F.floor(i / (b * c)).alias("i0"), (F.floor(i / c) % b).alias("i1"), (i % c).alias("i2"))
    x, y, z = (F.col(f"i{k}") - n / 2 for k, n in enumerate(dims))
    return cells.withColumn("v", (0.0001 * y * F.sin(y) + 0.0005 * F.cos(x * x + x) + z).cast("float"))


def worst(chunks, back):
    both = chunks.select("chunk_id", "vals").join(back.select("chunk_id", "decoded"), "chunk_id")
    err = both.select(F.array_max(F.zip_with("vals", "decoded", lambda p, q: F.abs(p - q))).alias("e"), F.size("decoded").alias("n"))
    return err.agg(F.max("e"), F.sum("n")).first()


DIMS = (40, 50, 60)


@pytest.mark.parametrize("conf", [
    Config(dims=DIMS, algorithm=Algorithm.INTERP), Config(dims=DIMS, algorithm=Algorithm.LORENZO_REG),
    Config(dims=DIMS, algorithm=Algorithm.LORENZO_REG, lorenzo2=True, regression2=True),
    Config(dims=DIMS, algorithm=Algorithm.INTERP, interpolator=Interpolator.LINEAR, quant_bins=64)], ids=str)
def test_smoke_field(spark, conf):
    chunks = codec.to_chunks(smoke_field(spark, DIMS), [], list(DIMS), [16, 25, 32])
    packed = codec.compress(chunks, [], conf).cache()
    e, n = worst(chunks, codec.decompress(packed, conf))
    assert n == math.prod(DIMS) and e <= conf.abs_bound * (1 + 1e-12)
    assert packed.agg(F.sum(codec.packed_bytes())).first()[0] < n * 4 / 3


def test_smoke_field_tuned(spark):
    conf = Config(dims=DIMS, element_type="float32")
    chunks = codec.to_chunks(smoke_field(spark, DIMS), [], list(DIMS), [40, 25, 30])
    packed = tuner.compress_tuned(chunks, [], conf)
    e, n = worst(chunks, tuner.decompress_tuned(packed, conf))
    assert n == math.prod(DIMS) and e <= conf.abs_bound * (1 + 1e-12)


def test_cells_round_trip(spark):
    cells = smoke_field(spark, (5, 7, 9))
    chunks = codec.to_chunks(cells, [], [5, 7, 9], [2, 3, 4])
    back = codec.to_cells(chunks, [], 3, {"vals": "v"})
    assert cells.selectExpr("i0", "i1", "i2", "double(v)").exceptAll(back).count() == 0
    assert back.count() == 5 * 7 * 9


EDGES = {
    "constant": (np.full(40, 3.5), (40,)), "ramp": (np.arange(60.0), (60,)), "single": (np.array([7.0]), (1,)),
    "tiny": (np.arange(19.0), (19,)), "thin": (np.arange(48.0), (8, 1, 6)), "remainder": (np.random.default_rng(0).normal(size=7 * 13), (7, 13)),
    "wild": (np.array([1.0, np.nan, np.inf, -np.inf, 1e300] * 8), (40,)),
    "four": (np.random.default_rng(1).normal(size=3 * 4 * 5 * 6), (3, 4, 5, 6)),
}


@pytest.mark.parametrize("name", EDGES)
@pytest.mark.parametrize("algo", [Algorithm.LORENZO_REG, Algorithm.INTERP, Algorithm.LOSSLESS])
def test_edges(spark, name, algo):
    vals, shape = EDGES[name]
    conf = Config(dims=shape, algorithm=algo, abs_bound=1e-3)
    chunks = spark.createDataFrame([(0, [0] * len(shape), list(shape), vals.tolist())],
                                   "chunk_id long, origin array<int>, dims array<int>, vals array<double>")
    back = np.array(codec.decompress(codec.compress(chunks, [], conf), conf).first().decoded)
    fine = np.isfinite(vals)
    assert (np.abs(back[fine] - vals[fine]) <= 1e-3 * (1 + 1e-12)).all()
    assert (np.isnan(back) == np.isnan(vals)).all() and (back[np.isinf(vals)] == vals[np.isinf(vals)]).all()


def test_zero_bound_is_lossless(spark):
    conf = Config(dims=(40,), algorithm=Algorithm.INTERP, mode=ErrorBoundMode.REL, rel_bound=0.0)
    vals = np.random.default_rng(2).normal(size=40)
    chunks = spark.createDataFrame([(0, [0], [40], vals.tolist())], "chunk_id long, origin array<int>, dims array<int>, vals array<double>")
    assert codec.decompress(codec.compress(chunks, [], conf), conf).first().decoded == vals.tolist()


@pytest.mark.parametrize("method", [md.ADAPTIVE, md.VQ, md.VQT, md.MT, md.LR, md.TS])
def test_md_methods(spark, method):
    """Atoms on regular levels that move a little: every method honours the bound."""
    rng = np.random.default_rng(3)
    level = rng.integers(0, 12, 300) * 2.0 + 1.0
    frames = level + rng.normal(0, 0.02, (25, 300))
    rows = spark.createDataFrame([("x", t, a, float(frames[t, a])) for t in range(25) for a in range(300)],
                                 "axis string, frame long, slot long, v double")
    conf = Config(dims=(10, 300), abs_bound=1e-2)
    packed = md.compress(rows, conf, 10, method, 128).cache()
    if method == md.ADAPTIVE:
        assert packed.select("lv.levels").distinct().first()[0] == 12
    back = md.decompress(packed, conf).toPandas()
    assert len(back) == 7500
    got = back.pivot(index="frame", columns="slot", values="v").to_numpy()
    assert np.abs(got - frames).max() <= 1e-2 * (1 + 1e-12)


def test_particles_with_one_crowded_cell(spark):
    """A third of the particles in one place, tiny chunks: nothing lost, bound kept, order is a permutation."""
    rng = np.random.default_rng(4)
    xyz = rng.normal(0, 20, (3000, 3))
    xyz[:1000] = xyz[0]
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    particles = pc.blocked(pts, [], 0.01, 4)
    cells = pc.numbered_cells(particles, [])
    back = pc.expand_cells(pc.decode_cells(pc.compress_cells(cells, [], 0.01, 64), []), [], 100)
    order = pc.output_positions(particles, cells, []).toPandas()
    assert sorted(order["position"]) == list(range(3000))
    got = back.toPandas().set_index("position").loc[order.set_index("pid").loc[range(3000), "position"], ["x", "y", "z"]].to_numpy()
    assert np.abs(got - xyz).max() <= 0.01 * (1 + 1e-9)


def test_raw_frames_and_single_cells(spark):
    wide = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 2e6, 1.0, 1.0), (2, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)],
                                 "frame long, x double, y double, z double")
    raw = pc.decompress_raw(pc.compress_raw(wide, ["frame"], 0.1), ["frame"]).toPandas()
    assert sorted(raw["x"]) == [0.0, 2e6] and set(raw["frame"]) == {1}
    kept = pc.blocked(wide, ["frame"], 0.1, 8).select("frame", "edge").distinct().collect()
    assert [tuple(r) for r in kept] == [(2, 1)]


def test_positions_read_stored_particles(spark):
    """Block ids cost far more than a read, so they are made once: what orders the particles no longer reads the table itself."""
    import __spark_entry__

    done = __spark_entry__.queries()["particle_codec"](spark, "/root/testdata/sf0.001")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1  # the comparison with the input
    assert done.first().bound_ok
