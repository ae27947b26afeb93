"""Closed loops and ordered decisions over rows, against a plain ordered run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from errbound.functions.quantizer import quantize_step
from errbound.operators import coefficients, interp, kdtree, sweep, temporal, wavefront
from errbound.session import checkpointed


def cells_of(spark, data, axes):
    rows = [(7, *map(int, at), float(v)) for at, v in np.ndenumerate(data)]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"{a} long" for a in axes) + ", v double")


def field(shape, seed):
    rng = np.random.default_rng(seed)
    grid = np.indices(shape).sum(axis=0)
    data = np.sin(grid / 3.0) + rng.normal(0, 0.05, shape)
    data.ravel()[rng.integers(data.size)] = 1e9
    return data


@pytest.mark.parametrize(("shape", "kind", "direction", "block"), [((37,), "cubic", 0, 8), ((6, 9), "linear", 1, 4), ((9, 5, 6), "cubic", 4, 32)])
def test_sweep_rows(spark, shape, kind, direction, block):
    axes, data = ["i", "j", "k"][:len(shape)], field(shape, 3)
    done = sweep.sweep_rows(cells_of(spark, data, axes), ["key"], axes, list(shape), "v", 0.01, 512, kind, direction, block)
    got = {tuple(r[a] for a in axes): (r.q, r.recon) for r in done.collect()}
    q, recon = interp.sweep(data.reshape(1, -1), shape, np.array([0.01]), 512, kind, direction, block)
    assert got == {at: (int(a), float(b)) for at, a, b in zip(np.ndindex(*shape), q[0], recon[0])} and (q == 0).any()
    coded = done.select("key", *axes, "q", F.when(F.col("q") == 0, F.col("v")).alias("kept"))
    back = sweep.unsweep_rows(coded, ["key"], axes, list(shape), "kept", 0.01, 512, kind, direction, block)
    assert {tuple(r[a] for a in axes): r.recon for r in back.collect()} == {at: r for at, (_, r) in got.items()}


def plain_lorenzo(data, eb, radius):
    rank, padded = data.ndim, np.zeros([n + 1 for n in data.shape])
    q = np.zeros(data.shape, int)
    for at in np.ndindex(*data.shape):
        pred = 0.0
        for back in np.ndindex(*[2] * rank):
            if any(back):
                pred += (1 if sum(back) % 2 else -1) * padded[tuple(a + 1 - b for a, b in zip(at, back, strict=True))]
        index, value = quantize_step(np.array([data[at]]), np.array([pred]), eb, radius)
        q[at], padded[tuple(a + 1 for a in at)] = index[0], value[0]
    return q, padded[tuple(slice(1, None) for _ in range(rank))]


@pytest.mark.parametrize(("shape", "tile"), [((23,), 5), ((11, 7), 4), ((11, 7), 64), ((5, 4, 6), 3)])
def test_lorenzo_fronts(spark, shape, tile):
    axes, data = ["i", "j", "k"][:len(shape)], field(shape, 5)
    cells = cells_of(spark, data, axes)
    done = wavefront.lorenzo_closed(cells, ["key"], axes, list(shape), "v", 0.01, 256, tile).collect()
    q, recon = plain_lorenzo(data, 0.01, 256)
    assert {tuple(r[a] for a in axes): r.q for r in done} == {at: int(q[at]) for at in np.ndindex(*shape)}
    assert all(abs(r.recon - recon[tuple(r[a] for a in axes)]) < 1e-9 and (r.q == 0 or abs(r.recon - data[tuple(r[a] for a in axes)]) <= 0.01) for r in done)


def test_long_arrays_make_few_fronts():
    """Cells of a tall plane, not its slices, decide how many fronts follow each other."""
    def fronts(shape):
        edges = wavefront.tile_edges(shape, 64)
        assert np.prod(np.minimum(edges, shape)) <= wavefront.CELLS
        return 1 + sum((n - 1) // e for n, e in zip(shape, edges, strict=True))

    assert fronts([600_000, 64]) == 147 and fronts([1 << 20]) == 4 and fronts([600_000, 128]) < 300
    assert wavefront.tile_edges([4096, 4096], 64) == [64, 64] and wavefront.tile_edges([0, 64], 64) == [64, 64]


@pytest.mark.parametrize(("shape", "tile", "cells"), [((23,), 5, 10), ((41, 4), 4, 40), ((4, 41), 4, 40)])
def test_lengthened_tiles(spark, monkeypatch, shape, tile, cells):
    monkeypatch.setattr(wavefront, "CELLS", cells)
    assert tile < max(wavefront.tile_edges(list(shape), tile)) < max(shape)
    test_lorenzo_fronts(spark, shape, tile)


def plain_coefficients(values, eb, precision, radius, still, patience):
    out, anchor, m, before, run = [], 0.0, 0, 0.0, 0
    for v in values:
        equal = abs(v - before) < precision * still
        kept = equal and run == patience
        run, before = run + 1 if equal else 0, v
        past = anchor + float(2 * m) * eb
        steps = int(abs(v - past) / eb) + 1
        moved = m + (-(steps >> 1) if v < past else steps >> 1)
        if not kept and steps < 2 * radius and abs(anchor + float(2 * moved) * eb - v) <= eb:
            out.append((radius + moved - m, anchor + float(2 * moved) * eb))
            m = moved
        else:
            out.append((0, v))
            anchor, m = v, 0
    return out


def test_coefficient_codes(spark):
    rng = np.random.default_rng(8)
    walk = np.cumsum(rng.normal(0, 0.3, 900))
    walk[200:420] = walk[200]  # a run of equal values is kept once
    walk[500:] += 1000.0  # beyond the range
    ties = np.arange(300) % 4 * 0.5 + 0.25  # halfway between multiples
    rows = [(e, i, float(v), 0.25) for e, x in enumerate((walk, ties, np.zeros(250))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "e int, b long, c double, eb double")
    got = {(r.e, r.b): (r.q, r.recon) for r in coefficients.code_coefficients(df, ["e"], ["b"], "c", "eb", 0.25, 512).collect()}
    want = {(e, i): x for e, v in enumerate((walk, ties, np.zeros(250))) for i, x in enumerate(plain_coefficients(v, 0.25, 0.25, 512, 1e-3, 100))}
    assert got == want
    assert want[0, 301][0] == 0 and want[0, 500][0] == 0 and want[2, 100][0] == 0 and sum(q == 0 for q, _ in want.values()) >= 3
    assert coefficients.code_coefficients(df.limit(0), ["e"], ["b"], "c", "eb", 0.25).count() == 0


def test_chain_of_changes_takes_few_rounds(spark, monkeypatch):
    """Halfway between multiples every state follows from the one before; such a chain once took a round for each block."""
    rows, calls = [(0, i, 0.25, 0.25) for i in range(400)], []

    def counted(df):
        calls.append(1)
        assert len(calls) < 20
        return checkpointed(df)

    monkeypatch.setattr(coefficients, "checkpointed", counted)
    df = spark.createDataFrame(rows, "e int, b long, c double, eb double")
    got = {r.b: (r.q, r.recon) for r in coefficients.code_coefficients(df, ["e"], ["b"], "c", "eb", 0.25, 512, patience=10_000).collect()}
    assert got == dict(enumerate(plain_coefficients(np.full(400, 0.25), 0.25, 0.25, 512, 1e-3, 10_000)))


def plain_choice(spatial, temporal):
    out, last, skip, limit = [], None, 0, 1
    for own, diff in zip(spatial, temporal, strict=True):
        tested = last is not None and skip == 0
        mode = int(tested and diff <= last)
        if mode:
            limit = 1
        elif tested:
            last, skip, limit = own, limit >> 1, min(2 * limit, 64)
        else:
            last, skip = own, max(skip - 1, 0)
        out.append((mode, tested))
    return out


@pytest.mark.parametrize(("frames", "segment"), [(100_000, 4096), (700, 7), (300, 1)])
def test_frame_choice_in_segments(spark, frames, segment):
    rng = np.random.default_rng(frames)
    spatial = 100 + 20 * np.sin(np.arange(frames) / 40) + rng.normal(0, 3, frames)
    temporal = spatial + rng.normal(0, 12, frames) * (rng.random(frames) < 0.7) + 30 * (np.sin(np.arange(frames) / 150) > 0.3)
    rows = spark.createDataFrame([(k, i, float(s), float(t)) for k in (1, 2) for i, (s, t) in enumerate(zip(spatial[::k], temporal[::k], strict=True))],
                                 "run int, frame int, spatial_bits double, temporal_bits double")
    chosen = temporal_rows(rows, ["run"], segment)
    for k in (1, 2):
        assert [x[2:] for x in chosen if x[0] == k] == plain_choice(spatial[::k], temporal[::k])
    one = temporal_rows(rows.where("run = 1").drop("run"), [], segment)
    assert [x[1:] for x in one] == plain_choice(spatial, temporal) and len(chosen) == frames + -(-frames // 2)


def temporal_rows(rows, keys, segment):
    return [tuple(r) for r in temporal.choose_frames(rows, keys, segment).orderBy(*keys, "frame").collect()]


def test_exact_medians(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 1, (300, 3)), np.full((200, 3), 2.5), rng.lognormal(0, 200, (100, 3)), -rng.lognormal(0, 3, (50, 3)), np.zeros((3, 3))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points] + [(None, 1.0, 2.0), (float("inf"), 0.0, 0.0)], "x double, y double, z double")
    got = {r.node: r.n for r in kdtree.kd_boxes(kdtree.kd_nodes(df, 4)).collect()}
    nodes = {1: np.array([[np.nan if v is None else v for v in r] for r in df.collect()])}
    for level in range(4):
        split = {}
        for node, rows in nodes.items():
            v = rows[:, level % 3]
            fine = np.sort(v[~np.isnan(v)])
            right = v > fine[(len(fine) - 1) // 2] if len(fine) else np.zeros(len(v), bool)
            split |= {2 * node + side: part for side, part in ((0, rows[~right]), (1, rows[right])) if len(part)}
        nodes = split
    assert got == {node: len(rows) for node, rows in nodes.items()}


def test_medians_take_two_scans_a_level(spark, monkeypatch):
    df = spark.range(60_000).select(*[(F.rand(seed) * 1e4).alias(a) for seed, a in enumerate("xyz")])
    scans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: scans.append(1) or collect(self))
    cuts = kdtree.kd_cuts(df, 4)
    assert len(scans) <= 8
    monkeypatch.undo()
    assert cuts[0] == sorted(r.x for r in df.collect())[29_999]


@pytest.mark.parametrize("fine,exact", [(1, 0), (1, 1 << 20), (256, 50)])
def test_medians_do_not_depend_on_the_scans(spark, monkeypatch, fine, exact):
    monkeypatch.setattr(kdtree, "FINE", fine)
    monkeypatch.setattr(kdtree, "EXACT", exact)
    test_exact_medians(spark)
