"""Particles and atoms that are not in every frame, frames outside the grid, long runs."""

import numpy as np
import pytest

from errbound.config import Config
from errbound.operators import temporal
from errbound.operators.levels import fit_levels
from errbound.plans import md_codec as md
from errbound.plans import particle_codec as pc


def walk(rows):
    """Frame choice, step by step."""
    last, skip, limit, out = None, 0, 1, []
    for frame, spatial, temp in rows:
        if last is None:
            last, mode, tested = spatial, 0, False
        elif skip:
            last, skip, mode, tested = spatial, skip - 1, 0, False
        elif temp <= last:
            limit, mode, tested = 1, 1, True
        else:
            last, skip, limit, mode, tested = spatial, limit // 2, min(limit * 2, 64), 0, True
        out.append((frame, mode, tested))
    return out


def test_choice_runs_through_long_runs(spark):
    rng = np.random.default_rng(0)
    rows = {k: [(f, float(s), float(t)) for f, (s, t) in enumerate(zip(rng.integers(5, 15, 1500), rng.integers(8, 40, 1500)))] for k in "ab"}
    sizes = spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v], "k string, frame long, spatial_bits double, temporal_bits double")
    got = temporal.choose_frames(sizes, ["k"]).collect()
    for k in "ab":
        assert sorted(tuple(r)[1:] for r in got if r.k == k) == walk(rows[k])
    assert temporal.choose_frames(sizes.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_trajectory_keeps_every_row(spark, wide):
    """Late starts, gaps, a missing batch opener and, in some frames, a range outside the grid."""
    rng = np.random.default_rng(1)
    rows = [(p, f, *map(float, rng.integers(0, 40, 3) * (1e6 if wide and f % 3 == 1 and p % 2 else 1.0)))
            for p in range(30) for f in range(20) if f != 8 and (f >= p % 5) and (p + f) % 7]
    df = spark.createDataFrame(rows, "pid long, frame long, x double, y double, z double")
    key_frames, batches, order = pc.compress_trajectory(df, 0.25, 8, 4)
    back = pc.decompress_trajectory(key_frames, batches, 0.25).join(order, ["anchor", "position"])
    got = sorted((r.pid, r.anchor + r.step, round(r.x), round(r.y), round(r.z)) for r in back.collect())
    assert got == sorted((p, f, round(x), round(y), round(z)) for p, f, x, y, z in rows)


@pytest.mark.parametrize("method", [md.ADAPTIVE, md.VQT, md.MT, md.LR, md.TS])
def test_md_keeps_every_row(spark, method):
    """Atoms absent in the first frame, ragged tiles, a frame that nobody is in."""
    rng = np.random.default_rng(2)
    kept = [(f, a) for f in range(3, 24) for a in range(40) if f != 11 and (a < 16 or f > 12) and rng.random() < 0.8]
    rows = [("x", f, a, float(rng.integers(0, 6))) for f, a in kept]
    conf = Config(dims=(10, 40), abs_bound=0.25)
    df = spark.createDataFrame(rows, "axis string, frame long, slot long, v double")
    back = md.decompress(md.compress(df, conf, 10, method, 16), conf)
    assert sorted((r.axis, r.frame, r.slot, float(round(r.v))) for r in back.collect()) == sorted(rows)


def test_fine_grid_and_wide_frame_share_a_container(spark):
    rows = [(0, i, float(i * 1000), float(i), 0.0) for i in range(500)] + [(1, i, i * 1e5, 1.0, 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, "frame long, pid long, x double, y double, z double")
    packed = pc.compress_frames(df, ["frame"], 5e-4, 8)
    assert packed.where("raw IS NOT NULL").select("frame").distinct().collect() == [(1,)]
    back = pc.decode_frames(packed, ["frame"]).join(pc.frame_order(df, ["frame"], 5e-4, 8), ["frame", "position"])
    assert sorted((r.frame, r.pid, round(r.x), round(r.y), round(r.z)) for r in back.collect()) == sorted((f, p, *map(round, v)) for f, p, *v in rows)


def test_levels_read_every_value(spark):
    """A few rows carry the top level; nulls and NaN take no part."""
    rows = [("a", float(i % 4)) for i in range(4000)] + [("a", 4.0)] * 30 + [("a", None), ("a", float("nan")), ("b", 1.0)]
    got = {r.k: (round(r.start, 6), round(r.offset, 6), r.levels) for r in fit_levels(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": (0.0, 1.0, 5), "b": (0.0, 0.0, 0)}
