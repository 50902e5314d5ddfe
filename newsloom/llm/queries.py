"""One registered query per operator, over its whole table and with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.backoff import backoff_scores
from newsloom.llm.exact_dedup import DigestIndex, exact_dedup
from newsloom.llm.hard_negatives import hard_negatives, relabelled
from newsloom.llm.jaccard import similar_documents
from newsloom.llm.licenses import license_scan
from newsloom.llm.merkle import lower_ascii, merkle_manifest
from newsloom.llm.multi_index import near_vectors
from newsloom.llm.packing import packed_sequences
from newsloom.llm.pieces import piece_counts
from newsloom.llm.substring import substring_dedup
from newsloom.llm.tokens import token_counts
from newsloom.llm.toxicity import toxicity
from newsloom.llm.warc import archived_pages
from newsloom.session import ship_package, stage

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = DigestIndex(spark)
    decided = stage(exact_dedup(docs, index), "decided")
    index.drop()
    return decided


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower_ascii(text)).otherwise(text)
    return merkle_manifest(_table(spark, sf_dir, "documents"), tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    return hard_negatives(_table(spark, sf_dir, "embeddings"), relabelled(vec_id, F.col("label")), vec_id % 100 == 0)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("n_fuzzy")


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scores": op5_lm_scores,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_packing": op7_packing,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_license_scan": op13_license_scan,
}
