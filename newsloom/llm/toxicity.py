"""Toxicity scores from a linear model on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.packed import lean, slices

ORDERS = (3, 4, 5)
MAX_PER_CLASS = 1000
"""Bound of the training sample: labelled rows of each class, the smallest by a hash of the id."""
MAX_GRAMS = 1 << 15
"""N-grams of a training text that reach the driver: those of the whole text, with more the smallest by their hash."""
MAX_FEATURES = 10_000
"""Columns of the fitted model, which travels with every task."""
FOLDS = 5

SLICE = 1 << 20
"""Bytes of text that a task scores at once; an n-gram takes several times the bytes of a character."""

_STEPS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09)
_BITS = 22


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text divides by FOLDS; rows without an id are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: 32-bit hashes of the lower-case n-grams of all texts, and the text each belongs to."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    points = np.where((points >= 9) & (points <= 13), np.uint32(32), points)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    total = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(points):
            return
        total = total[: len(points) - n + 1] + (points[n - 1:] + np.uint32(1)) * np.uint32(_STEPS[n - 1])
        if n in ORDERS:
            h = total ^ (total >> np.uint32(15))
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            h *= np.uint32(0x297A2D39)
            h ^= h >> np.uint32(15)
            whole = doc[: len(h)] == doc[n - 1:]
            yield h[whole], doc[: len(h)][whole]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each training text as the set of its n-gram hashes. They are well mixed, so the smallest ones are a fair sample."""
    for batch in batches:
        found = [np.unique(np.concatenate([h for h, _ in _grams([t])] or [np.zeros(0, np.uint32)]))[:MAX_GRAMS].tobytes()
                 for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.binary())], ["toxic", "grams"])


@dataclass(frozen=True)
class Model:
    """Sorted n-gram hashes, their weights (ratio times coefficient), and the intercept."""

    grams: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text; an n-gram counts once however often it occurs."""
        keys = []
        for h, doc in _grams(texts):
            maybe = np.flatnonzero(table[h >> np.uint32(32 - _BITS)])
            some = h[maybe]
            at = np.minimum(np.searchsorted(self.grams, some), max(len(self.grams) - 1, 0))
            real = self.grams[at] == some
            keys.append(doc[maybe[real]].astype(np.int64) << 32 | at[real])
        total = np.full(len(texts), self.intercept)
        if keys:
            key = np.unique(np.concatenate(keys))
            total += np.bincount(key >> 32, self.weights[key & 0xFFFFFFFF], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def table(self) -> np.ndarray:
        """Which leading bits of a hash occur in the model; most n-grams are ruled out by it."""
        table = np.zeros(1 << _BITS, bool)
        table[self.grams >> np.uint32(32 - _BITS)] = True
        return table


def fitted(sets: list[np.ndarray], labels: np.ndarray, odds: float) -> Model:
    """Logistic regression on presence times log-count ratio. ``odds``: of label 1 among all labelled rows."""
    empty = Model(np.zeros(1, np.uint32), np.zeros(1), float(np.log(odds)))
    if not len(labels) or labels.min() == labels.max():
        return empty
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    grams, both = np.unique(np.concatenate(sets), return_counts=True)
    some, count = np.unique(np.concatenate([s for s, y in zip(sets, labels, strict=True) if y]), return_counts=True)
    one = np.zeros(len(grams), np.int64)
    one[np.searchsorted(grams, some)] = count
    p, q = (one + 1) / (n1 + 2), (both - one + 1) / (n0 + 2)
    ratio = np.log(p / q)
    strength = np.abs(p - q) / np.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
    chosen = np.flatnonzero((both >= 3) & (strength >= 3))
    chosen = np.sort(chosen[np.argsort(-strength[chosen], kind="stable")[:MAX_FEATURES]])
    if not len(chosen):
        return empty
    grams, ratio = grams[chosen], ratio[chosen]
    found = [np.flatnonzero(np.isin(grams, s, assume_unique=True)) for s in sets]
    rows, columns = np.repeat(np.arange(len(sets)), [len(f) for f in found]), np.concatenate(found)
    values = ratio[columns]
    # Accelerated gradient descent. A step of 1 / L, with L bounded by a power iteration on the squared matrix.
    v = np.ones(len(chosen))
    for _ in range(20):
        v /= np.linalg.norm(v)
        v = np.bincount(columns, values * np.bincount(rows, values * v[columns], len(labels))[rows], len(chosen))
    ridge, n = 1e-4, len(labels)
    step = 1 / (np.linalg.norm(v) / (4 * n) + ridge)
    w = before = np.zeros(len(chosen))
    bias = bias_before = 0.0
    for k in range(1, 201):
        ahead, bias_ahead = w + (k - 1) / (k + 2) * (w - before), bias + (k - 1) / (k + 2) * (bias - bias_before)
        z = np.bincount(rows, values * ahead[columns], n) + bias_ahead
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / n
        before, bias_before = w, bias
        w = ahead - step * (np.bincount(columns, values * error[rows], len(chosen)) + ridge * ahead)
        bias = bias_ahead - min(step, 4.0) * error.sum()
    return Model(grams, w * ratio, float(bias + np.log(odds) - np.log(n1 / n0)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    At most MAX_PER_CLASS rows of each class reach the driver, each as at most MAX_GRAMS hashes of n-grams of its whole
    text. Rows without a label or id are not used; of several labels the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_CLASS) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    # The broadcast side has at most 2 * MAX_PER_CLASS rows.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(sample), "doc_id").select("toxic", "text")
    got = texts.mapInArrow(lean(_seen), "toxic int, grams binary").collect()
    odds = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5)
    return fitted([np.frombuffer(r["grams"], np.uint32) for r in got], np.array([r["toxic"] for r in got], np.int64), odds)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted in front of the other columns; the scan's partitions stay as they are."""
    schema = "score double, predicted int" + "".join(f", c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in slices(batches, f"c{at}", SLICE):
            score = model.scores(batch[f"c{at}"].to_pylist(), table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *batch.columns],
                ["score", "predicted", *batch.schema.names])

    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return renamed.mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, held_out, score, predicted.

    Whole texts are scored, NULL as the empty text, which gets the score of the label frequencies alone. Without
    labels of both classes every score is that. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(docs, fit(docs, labels)).select(
        F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, all columns unchanged."""
    kept = scored(docs, fit(docs, labels)).filter("predicted = 0")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
