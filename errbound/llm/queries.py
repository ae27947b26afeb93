"""Registered queries of the operators, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bitsliced, count_cache, decontaminate, divergence, hilbert, language_crf, minhash, snapshots, token_files, tree_bpe, vertical_join, warc
from .common import fresh_dir, table
from .encoders import public_path

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_crf.detect_languages(docs, language_crf.train(docs))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.document_shards(table(spark, sf_dir, "documents"))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.collapse_snapshots(table(spark, sf_dir, "conversations"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_path(WORD_BPE))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_count_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_cache.token_counts(table(spark, sf_dir, "documents"), fresh_dir(spark, "counts"), public_path(BYTE_BPE))


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode_decode(table(spark, sf_dir, "documents"), public_path(BYTE_BPE))


def op8_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_pointer_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), public_path(BYTE_BPE), public_path(PIECE_BPE))


def op13_vertical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical_join.similar_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_crf": (op1_language_crf, None),
    "op2_hilbert_shards": (op2_hilbert_shards, None),
    "op3_snapshot_collapse": (op3_snapshot_collapse, snapshots.ORACLE),
    "op4_token_files": (op4_token_files, None),
    "op5_circulant_minhash": (op5_circulant_minhash, minhash.ORACLE),
    "op6_count_cache": (op6_count_cache, None),
    "op7_tree_bpe": (op7_tree_bpe, None),
    "op8_zstd_warc": (op8_zstd_warc, warc.ORACLE),
    "op9_bitsliced_topk": (op9_bitsliced_topk, bitsliced.ORACLE),
    "op10_latent_decontamination": (op10_latent_decontamination, None),
    "op11_pointer_divergence": (op11_pointer_divergence, divergence.ORACLE),
    "op12_lockstep_alignment": (op12_lockstep_alignment, None),
    "op13_vertical_join": (op13_vertical_join, vertical_join.ORACLE),
    "pipeline": (pipeline, None),
}
