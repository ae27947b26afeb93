"""Command line, block-size search corner cases, schedules and samplers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from errbound import api
from errbound.__main__ import main
from errbound.config import Config
from errbound.operators import particles as pt
from errbound.operators import sampling, temporal, transforms
from errbound.plans import md_codec
from errbound.plans import particle_codec as pc
from errbound.sources import container


def test_array_command(spark, tmp_path, capsys):
    data = np.random.default_rng(0).normal(size=(12, 10, 9)).cumsum(axis=0).astype("<f4")
    data.tofile(tmp_path / "in.dat")
    main(["array", "-i", str(tmp_path / "in.dat"), "-z", str(tmp_path / "z"), "-o", str(tmp_path / "out.dat"),
          "-d", "12", "10", "9", "-M", "REL", "-R", "1e-3", "-a"])
    back = np.fromfile(tmp_path / "out.dat", "<f4")
    # The bound holds on the decoded doubles; writing floats rounds once more.
    assert np.abs(back - data.ravel()).max() <= 1e-3 * (data.max() - data.min()) * (1 + 1e-4)
    assert "psnr" in capsys.readouterr().out


def test_particle_command(spark, tmp_path):
    rng = np.random.default_rng(1)
    files = []
    for a in "xyz":
        (rng.normal(0, 5, 200) + rng.normal(0, 0.01, (6, 200)).cumsum(axis=0)).astype("<f4").tofile(tmp_path / a)
        files.append(str(tmp_path / a))
    main(["particles", "-i", *files, "-z", str(tmp_path / "t"), "-s", "6", "200", "-e", "0.01", "-b", "3", "-O", "64"])
    key_frames, batches = container.read_trajectory(spark, str(tmp_path / "t"))
    order = spark.read.parquet(str(tmp_path / "t" / "order"))
    back = pc.decompress_trajectory(key_frames, batches, 0.01).join(order, ["anchor", "position"])
    got = back.select((F.col("anchor") + F.col("step")).alias("frame"), "pid", "x").toPandas().sort_values(["frame", "pid"])
    want = np.fromfile(files[0], "<f4")
    assert len(got) == 1200 and np.abs(got["x"].to_numpy() - want).max() <= 0.01 * (1 + 1e-9)
    only, _ = container.read_trajectory(spark, str(tmp_path / "t"), [0])
    assert {r.anchor for r in only.select("anchor").collect()} == {0}
    main(["particles", "-i", *files, "-z", str(tmp_path / "f"), "-s", "6", "200", "-e", "0.01", "-O", "32"])
    cells = pc.decode_cells(spark.read.parquet(str(tmp_path / "f" / "frames")), ["frame"])
    assert [r.n for r in cells.groupBy("frame").agg(F.sum("n").alias("n")).collect()] == [200] * 6


@pytest.mark.parametrize("batch", ["0", "4"])
def test_particle_files_come_back(spark, tmp_path, capsys, batch):
    rng = np.random.default_rng(5)
    files, outs = [str(tmp_path / a) for a in "xyz"], [str(tmp_path / f"{a}.back") for a in "xyz"]
    data = [(rng.normal(0, 5, 150) + rng.normal(0, 0.01, (5, 150)).cumsum(axis=0)).astype("<f4") for _ in files]
    for x, path in zip(data, files):
        x.tofile(path)
    main(["particles", "-i", *files, "-z", str(tmp_path / "p"), "-s", "5", "150", "-e", "0.02", "-b", batch, "-O", "64", "-a"])
    assert "max_abs_err" in capsys.readouterr().out
    main(["particles", "-z", str(tmp_path / "p"), "-o", *outs])  # from the container alone
    for x, path in zip(data, outs):
        assert np.abs(np.fromfile(path, "<f4").reshape(x.shape) - x).max() <= 0.02 * (1 + 1e-4)
    one = api.decompress_particles(spark, str(tmp_path / "p"), [2])
    assert one.count() == 150 and {r.frame for r in one.select("frame").distinct().collect()} == {2}
    main(["particles", "-i", *files, "-z", str(tmp_path / "u"), "-s", "5", "150", "-e", "0.02", "-b", batch, "-osn"])  # no permutation: own order
    assert np.allclose(np.sort(np.fromfile(f"{files[0]}.out", "<f4").reshape(5, 150)), np.sort(data[0]), atol=0.0201)
    with pytest.raises(ValueError, match="permutation"):
        main(["particles", "-i", *files, "-z", str(tmp_path / "u"), "-a"])


@pytest.mark.parametrize("axes", ["x", "xyz"])
def test_md_files_come_back(spark, tmp_path, capsys, axes):
    rng = np.random.default_rng(6)
    files, outs = [str(tmp_path / a) for a in axes], [str(tmp_path / f"{a}.back") for a in axes]
    data = [(rng.integers(0, 6, 30) + rng.normal(0, 0.02, (23, 30)).cumsum(axis=0)).astype("<f4") for _ in files]
    for x, path in zip(data, files):
        x.tofile(path)
    main(["md", "-i", *files, "-z", str(tmp_path / "p"), "-s", "23", "30", "-A", "0.01", "-a"])
    assert capsys.readouterr().out.count("max_abs_err") == len(axes)
    main(["md", "-z", str(tmp_path / "p"), "-o", *outs])
    for x, path in zip(data, outs):
        assert np.abs(np.fromfile(path, "<f4").reshape(x.shape) - x).max() <= 0.01 * (1 + 1e-4)
    part = api.decompress_md(spark, str(tmp_path / "p"), [1])
    assert {r.frame for r in part.select("frame").distinct().collect()} == set(range(10, 20))


def test_md_rejects_two_values_of_an_atom(spark):
    rows = spark.createDataFrame([("x", 0, 0, 1.0), ("x", 0, 0, 2.0), ("x", 0, 1, 3.0)], "axis string, frame long, slot long, v double")
    with pytest.raises(Exception, match="several values"):
        md_codec.compress(rows, Config(dims=(1, 2), abs_bound=0.1), 10).collect()


def test_particles_missing_from_frame_0_start_from_zero(spark):
    rows = [(p, f, float(p + f)) for p in range(10) for f in range(6) if p or f]
    df = spark.createDataFrame(rows, "pid long, frame long, x double")
    done = temporal.temporal_batches(df, ["pid"], "x", 0.1, 6, 64, temporal.first_frame(df, ["pid"], "x"))
    assert done.count() == 10


def test_md_command(spark, tmp_path):
    np.random.default_rng(2).normal(size=(20, 40)).astype("<f4").tofile(tmp_path / "m")
    main(["md", "-i", str(tmp_path / "m"), "-z", str(tmp_path / "z"), "-s", "20", "40", "-R", "1e-3"])
    table, conf = container.read_container(spark, str(tmp_path / "z"))
    assert table.select("batch").distinct().count() == 2 and conf.quant_bins == 1024


def test_fallbacks_and_spans():
    assert pt.blocking_fallback([2e6, 1, 1], 0.1) == 0
    assert pt.blocking_fallback([2.0 ** 32 * 1e-5, 1, 1], 1e-5) == 0
    assert pt.blocking_fallback([1.6, 1.6, 1.6], 0.1) == 1
    assert pt.blocking_fallback([1.7, 1.6, 1.6], 0.1) is None
    assert pt.exponent_range(1000.0, 1e-4) == (5, 24)


def test_exhaustive_edges(spark):
    rng = np.random.default_rng(3)
    pts = spark.createDataFrame([tuple(map(float, p)) for p in rng.normal(0, 3, (500, 3))], "x double, y double, z double")
    ranges = list(map(float, pt.bounding_box(pts, []).select("rx", "ry", "rz").first()))
    edges = [(a, b, c) for a in (2, 4) for b in (2, 4) for c in (2, 4)]
    sizes = pt.trial_sizes(pts, ranges, 0.05, edges).collect()
    assert {(r.bx, r.by, r.bz) for r in sizes} == set(edges)
    cubes = {r.bx: r.bits for r in pt.trial_sizes(pts, ranges, 0.05, [(2,) * 3, (4,) * 3]).collect()}
    assert {r.bx: r.bits for r in sizes if r.bx == r.by == r.bz} == pytest.approx(cubes)


def test_tight_schedule(spark):
    frames = spark.range(0, 100, 2).selectExpr("id AS frame")
    got = {r.frame: r.divisor for r in temporal.tight_schedule(frames, [], 100, 5.0, 16).collect()}
    assert [got[f] for f in (0, 2, 4, 6, 8, 10)] == [5.0, 4.0, 3.0, 2.0, 1.0, 1.0]
    assert got[16] == 5.0 and got[36] == 1.0


def test_samplers(spark):
    df = spark.range(5000).selectExpr("id % 3 AS k", "id")
    a, b = (sampling.hashed_sample(df, ["k"], ["id"], 50) for _ in range(2))
    assert a.groupBy("k").count().where("count = 50").count() == 3 and a.exceptAll(b).count() == 0
    s = [r.id for r in sampling.shuffled(spark.range(500), ["id"]).collect()]
    assert sorted(s) == list(range(500)) and s != sorted(s)


def test_rough_mean_walk(spark):
    """The closed form of the strided walk against the step-by-step walk."""
    dims = [20, 9, 50]
    data = np.random.default_rng(5).normal(size=int(np.prod(dims)))
    step, at, row, plane, stops = int(np.sqrt(len(data))), 0, 0, 0, []
    while at < len(data):
        stops.append(at)
        at, row, plane = at + step, row + step, plane + step
        if row >= dims[2]:
            row, at = 0, at - 1
        if plane >= dims[1] * dims[2]:
            plane, at = 0, at - 1
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(data)], "idx long, v double")
    got = sampling.rough_mean(cells, "idx", "v", dims).first()[0]
    assert got == pytest.approx(data[stops].mean())


def test_pivot_inverts_unpivot(spark):
    df = spark.range(50).selectExpr("id AS pid", "id * 1.0D AS x", "id * 2.0D AS y", "id * 3.0D AS z")
    assert transforms.pivot_axes(transforms.unpivot_axes(df, ["pid"]), ["pid"]).exceptAll(df).count() == 0


def test_log_transform_handles_signs_and_zero(spark):
    vals = [0.0, -3.0, 5.0, 1e-6, -1e6]
    df = transforms.log_transform(spark.createDataFrame([(v,) for v in vals], "v double"), "v", 1e-3)
    back = df.withColumn("b", transforms.log_inverse("log_v", "sign_v", "min_log", "log_eb")).collect()
    assert [r.b for r in back] == pytest.approx([r.v for r in back])
