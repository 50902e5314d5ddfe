"""Packing by power-of-two decomposition: pieces of binary lengths, equal lengths in one bucket."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.packed import Words, lean, part_count, slices
from newsloom.llm.tokens import WordTokens
from newsloom.session import stage

SEQUENCE = 4096
END = 2
SLICE = 1 << 20
"""Bytes of text a task turns into words and ids at once."""


def binary_pieces(tokens: np.ndarray, longest: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut lengths into pieces of ``longest`` and then of falling powers of two: owner, start and length of each."""
    bits = longest.bit_length() - 1
    sizes = longest >> np.arange(1, bits + 1)
    counts = np.concatenate([(tokens // longest)[:, None], (tokens[:, None] & sizes) > 0], axis=1).astype(np.int64)
    length = np.repeat(np.tile(np.concatenate([[longest], sizes]), len(tokens)), counts.ravel())
    owner = np.repeat(np.arange(len(tokens)), counts.sum(1))
    end = np.cumsum(length)
    return owner, end - length - (np.cumsum(tokens) - tokens)[owner], length


def pieces(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, and with ``with_ids`` the ids themselves."""
    if longest & (longest - 1):
        raise ValueError("the sequence length has to be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(tokenizer)
        for batch in slices(batches, size=SLICE):
            words = Words(batch["text"])
            ids, bounds = tokens.ids(words)
            ids = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            size = np.diff(bounds)
            owner, start, length = binary_pieces(size, longest)
            first = bounds[owner] + start
            view = memoryview(ids).cast("B")
            cuts = [view[4 * a:4 * b] for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            columns = [
                batch["doc_id"].take(pa.array(owner)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(size[owner], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([bytes(c) for c in cuts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), schema)


def packed_sequences(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """Every token of every document in exactly one sequence: the columns of :func:`pieces`, sequence_id and offset.

    A document is its ids and then ``end_id``; NULL and empty texts are that id alone. Each piece is a sequence of its
    own with a power of two of tokens, so no sequence crosses documents and nothing is padded. Sequences are numbered
    from 0 bucket by bucket, the longest first, and inside a bucket by doc_id and start: batches of one length are
    ranges of numbers. Repeated rows are packed each. Other columns are ignored.
    """
    staged = stage(pieces(docs, tokenizer, longest, end_id, with_ids), "pieces")
    order = [F.desc("length"), F.asc("doc_id"), F.asc("start")]
    parts = part_count(docs.sparkSession)
    ranged = stage(staged.repartitionByRange(parts, *order).sortWithinPartitions(*order), "sequences")
    placed = ranged.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # A row per file. The files are ranges in order, so the numbers before a file are those of the files before it.
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"), F.max("length").alias("_l"), F.min(
        F.struct(-F.col("length"), "doc_id", "start")).alias("_at"))
    before = Window.orderBy("_at", "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_file").select(
        *staged.columns, (F.col("_before") + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
