"""Token counts through a cache keyed by content digest and tokenizer version.

The cache is a Parquet table in a shared folder, one folder for each tokenizer digest: content_digest (SHA-256 of
the normalised content) and n_tokens.  Content is normalised only as far as no count can change: null is the
empty text.  One run joins the documents' digests to the cache, encodes each distinct miss once, appends the
misses, and counts every document from the cache.

Rows: every row gets a count, repeated rows and null doc_ids too; an empty table gives an empty result; other
columns are ignored.  A digest that two runs appended at a time counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, utf8_bytes
from .encoders import counter, version_digest

CACHE_SCHEMA = "content_digest binary, n_tokens long"


def _count(tokenizer: str):
    def count(batches):
        import pyarrow as pa

        for batch in small_batches(batches):
            found = counter(tokenizer).count(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(found, pa.int64())],
                                            names=["content_digest", "n_tokens"])
    return count


def read_cache(spark, folder: str, tokenizer: str) -> DataFrame:
    path = f"{folder}/tokenizer={version_digest(tokenizer)}"
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)  # the first run finds a table too
    kept = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return kept.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def misses(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct contents without a stored count: content_digest, content."""
    content = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.unhex(F.sha2(content.cast("binary"), 256)).alias("content_digest"), content.alias("content"))
    return named.groupBy("content_digest").agg(F.first("content").alias("content")).join(cache, "content_digest", "left_anti")


def fill_cache(docs: DataFrame, folder: str, tokenizer: str) -> None:
    spark = docs.sparkSession
    fresh = misses(docs, read_cache(spark, folder, tokenizer))
    fresh.mapInArrow(_count(tokenizer), CACHE_SCHEMA).write.mode("append").parquet(f"{folder}/tokenizer={version_digest(tokenizer)}")


def token_counts(docs: DataFrame, folder: str, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; `folder` holds the cache and keeps what was counted."""
    fill_cache(docs, folder, tokenizer)
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = docs.select("doc_id", utf8_bytes(F.col("text")).alias("n_bytes"), digest.alias("content_digest"))
    known = stored(read_cache(docs.sparkSession, folder, tokenizer), "counts")  # a plain table: a common digest's rows can be split
    return (rows.join(known, "content_digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
