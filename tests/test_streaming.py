import numpy as np
from pyspark.sql import functions as F

from errbound.operators.ordering import from_chunks
from errbound.operators.temporal import temporal_batches
from errbound.streaming.live import live_temporal


def test_live_equals_batch(spark, tmp_path):
    """Frames that arrive in several files give what one closed loop over the whole run gives."""
    rng = np.random.default_rng(0)
    rows = [(p, t, *map(float, rng.normal(0, 5, 3))) for t in range(12) for p in range(20)]
    df = spark.createDataFrame(rows, "pid long, frame long, x double, y double, z double")
    for k in range(3):
        df.where(F.floor(F.col("frame") / 4) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (live_temporal(stream, 0.5, 64).writeStream.format("memory").queryName("live")
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    live = spark.table("live").select("pid", "frame", "qx", F.round("rx", 9).alias("rx"))
    batch = from_chunks(temporal_batches(df, ["pid"], "x", 0.5, 12, 64), ["pid"], 12, {"q": "q", "recon": "r"}, "frame", "batch")
    want = batch.select("pid", "frame", F.col("q").alias("qx"), F.round("r", 9).alias("rx"))
    assert live.count() == 240 and want.exceptAll(live).count() == 0
