"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Language ID drops documents without a determined language; near-duplicate removal keeps one document of each group;
decontamination drops documents that hold a benchmark item; the last stage encodes what is left.  All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from errbound.llm import decontaminate, language_crf, minhash, tree_bpe
from errbound.llm.common import shared_dir, table
from errbound.llm.encoders import public_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language, whatever its share; null texts and texts without letters go, rows without a doc_id are judged too."""
    return language_crf.determined(docs, language_crf.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each near-duplicate group; empty texts, rows without a doc_id and repeated rows of a kept one stay."""
    return minhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts and rows without a doc_id stay."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a row: the digests of its ids and of the text they decode to; a null text is an empty one."""
    return tree_bpe.encode_decode(docs, public_path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
