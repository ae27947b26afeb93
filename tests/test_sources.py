import numpy as np
import pytest
from pyspark.sql import functions as F

from errbound.config import Config
from errbound.sources import container, raw

TYPES = ["float32", "float64", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64"]


@pytest.mark.parametrize("dtype", TYPES)
def test_all_types_round_trip(spark, tmp_path, dtype):
    rng = np.random.default_rng(0)
    info = np.iinfo(dtype) if "int" in dtype else None
    values = rng.integers(info.min, info.max, 500, dtype=dtype, endpoint=True) if info else rng.normal(size=500).astype(dtype)
    values.tofile(tmp_path / "in.dat")
    df = raw.read_raw(spark, str(tmp_path / "in.dat"), dtype, rows_per_partition=64)
    assert df.rdd.getNumPartitions() == 8
    assert [r.idx for r in df.orderBy("idx").collect()] == list(range(500))
    raw.write_raw(df.orderBy(F.rand(1)), str(tmp_path / "out.dat"), dtype)
    assert (tmp_path / "out.dat").read_bytes() == (tmp_path / "in.dat").read_bytes()


def test_offset_and_limit(spark, tmp_path):
    np.arange(100, dtype="<f4").tofile(tmp_path / "a.dat")
    df = raw.read_raw(spark, str(tmp_path / "a.dat"), offset=30, limit=20, rows_per_partition=7)
    rows = df.orderBy("idx").collect()
    assert [r.v for r in rows] == list(range(30, 50)) and rows[0].idx == 0
    with pytest.raises(Exception, match="asked for"):
        raw.read_raw(spark, str(tmp_path / "a.dat"), limit=101).count()


def test_columns_side_by_side(spark, tmp_path):
    paths = {}
    for k, a in enumerate("xyz"):
        (np.arange(50, dtype="<f4") + 100 * k).tofile(tmp_path / f"{a}.dat")
        paths[a] = str(tmp_path / f"{a}.dat")
    df = raw.read_raw_columns(spark, paths, rows_per_partition=9)
    assert df.where("y - x <> 100 OR z - x <> 200 OR x <> idx").count() == 0 and df.count() == 50


def test_text(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("v")).repartition(5)
    container.write_text(df, str(tmp_path / "t"))
    parts = sorted((tmp_path / "t").glob("part-*"))
    assert [int(x) for p in parts for x in p.read_text().split()] == [2 * i for i in range(300)]


def test_container(spark, tmp_path):
    conf = Config(dims=(4, 5), abs_bound=0.25)
    table = spark.range(6).selectExpr("id AS chunk_id", "id % 2 AS frame", "CAST('a' AS BINARY) AS payload")
    container.write_container(table, str(tmp_path / "c"), conf, ["frame"])
    back, read = container.read_container(spark, str(tmp_path / "c"))
    assert read == conf and back.where("frame = 1").count() == 3
    assert "PartitionFilters: [isnotnull(frame" in back.where("frame = 1")._jdf.queryExecution().toString()


def test_permutation_bits(spark, tmp_path):
    order = spark.range(10).selectExpr("id AS position", "9 - id AS pid")
    container.write_permutation(order, str(tmp_path / "o"), 32)
    assert dict(spark.read.parquet(str(tmp_path / "o")).dtypes) == {"position": "int", "pid": "int"}


def test_overwrite_sets_the_length(spark, tmp_path):
    import os

    path = str(tmp_path / "short.dat")
    for n in (1000, 10):
        raw.write_raw(spark.range(n).selectExpr("id as idx", "cast(id as float) as v"), path, "float32")
        assert os.path.getsize(path) == 4 * n
