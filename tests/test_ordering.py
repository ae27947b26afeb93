"""Ordered operators against pandas, with buckets so small that every key spans many."""

import numpy as np
import pandas as pd
import pytest

from errbound.operators import ordering as od
from errbound.operators.encoders import run_lengths


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    key = np.where(rng.random(4000) < 0.6, 1, rng.integers(2, 40, 4000))
    return pd.DataFrame({"k": key, "t": rng.integers(0, 10_000, 4000), "id": rng.permutation(4000),
                         "v": rng.normal(size=4000)})


def sorted_by(df, cols):
    return df.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("how", [{"rows_per_bucket": 50}, {"width": 100}, {}])
def test_position_and_sum(spark, skewed, how):
    got = od.ordered_prefix(spark.createDataFrame(skewed), ["k"], ["t", "id"], "pos", {"v": "s"}, **how).toPandas()
    want = sorted_by(skewed, ["k", "t", "id"])
    want["pos"] = want.groupby("k").cumcount()
    want["s"] = want.groupby("k")["v"].cumsum()
    got = sorted_by(got, ["k", "t", "id"])
    assert (got["pos"].to_numpy() == want["pos"].to_numpy()).all()
    np.testing.assert_allclose(got["s"], want["s"], atol=1e-9)


def test_position_without_keys(spark, skewed):
    got = od.with_position(spark.createDataFrame(skewed), [], ["id"], rows_per_bucket=100).toPandas()
    assert (got["pos"] == got["id"]).all()


@pytest.mark.parametrize("how", [{"rows_per_bucket": 30}, {"width": 7}, {"width": 100000}])
def test_lag_sparse(spark, skewed, how):
    one = skewed.drop_duplicates(["k", "t"])
    got = sorted_by(od.lag_sparse(spark.createDataFrame(one), ["k"], "t", ["v"], **how).toPandas(), ["k", "t"])
    want = sorted_by(one, ["k", "t"])
    np.testing.assert_allclose(got["prev_v"], want.groupby("k")["v"].shift(1))


@pytest.mark.parametrize("tile", [3, 64, 100000])
def test_neighbours(spark, skewed, tile):
    want = sorted_by(skewed, ["k", "t", "id"])
    want["pos"] = want.groupby("k").cumcount()
    got = od.with_neighbours(spark.createDataFrame(want), ["k"], "pos", ["v"], before=2, after=1, tile=tile).toPandas()
    got = sorted_by(got, ["k", "pos"])
    assert len(got) == len(want)
    for j in (1, 2):
        np.testing.assert_allclose(got[f"v_m{j}"], want.groupby("k")["v"].shift(j))
    np.testing.assert_allclose(got["v_p1"], want.groupby("k")["v"].shift(-1))


def test_chunks_round_trip(spark, skewed):
    want = sorted_by(skewed, ["k", "t", "id"])
    want["pos"] = want.groupby("k").cumcount()
    chunks = od.to_chunks(spark.createDataFrame(want), ["k"], "pos", "v", 17)
    back = sorted_by(od.from_chunks(chunks, ["k"], 17, {"vals": "v"}).toPandas(), ["k", "pos"])
    np.testing.assert_allclose(back["v"], want["v"])


def test_one_run_over_many_tiles(spark):
    df = spark.range(1000).selectExpr("1 AS k", "id AS pos", "IF(id < 900, 5, id) AS s")
    runs = sorted_by(run_lengths(df, ["k"], "pos", "s", tile=16).toPandas(), ["run_start"])
    assert runs["run_length"].tolist() == [900] + [1] * 100
