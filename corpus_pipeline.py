"""Documents to packed training sequences: stages that each take the documents the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.exact_dedup import DigestIndex, kept_documents
from newsloom.llm.jaccard import without_near_copies
from newsloom.llm.packing import packed_sequences
from newsloom.llm.substring import without_repeats
from newsloom.llm.toxicity import without_toxic
from newsloom.session import ship_package, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ARROW_ROWS = "500"
"""Rows of an Arrow batch: whole texts are long, and batches lie in memory on both sides of each worker."""


def _ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return ship_package(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside its held-out fold, does not reject."""
    return without_toxic(docs, _ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    index = DigestIndex(_ready(spark))
    kept = kept_documents(docs, index)
    index.drop()
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets."""
    _ready(spark)
    return without_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier place already has; ``n_chars`` follows the text."""
    _ready(spark)
    shorter = without_repeats(docs)
    if "n_chars" not in docs.columns:
        return shorter
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of powers of two of tokens, each a sequence with its token ids."""
    _ready(spark)
    return packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram jaccard join", near_copies),
    ("substring dedup", substrings),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
