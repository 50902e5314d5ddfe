"""Hard negatives for contrastive training: rows of other labels that score almost as high as a true partner.

Scores are exact inner products of integer vectors. Candidates are packed in the manner of Kronecker substitution: their
components, biased so that none is negative, become fields of one wide integer, and one multiplication by an anchor's
component serves all fields. Fields are wide enough for the whole sum, so nothing carries over, and the scores are read
back from them. The wide integer is a double's 53 bits, which matrix multiplication adds up without rounding; where
a field needs more, it is a Python integer of any width.

Candidates are dealt into blocks, each one task's memory; anchors pass through every block a batch at a time. A first round
finds the positives, a second one, which knows their scores, the negatives. Each block gives at most the wanted number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.packed import NO_ID, part_count
from newsloom.session import stage

SCALE = 256
BLOCK = 1 << 16
"""Candidates of a block, on average; with fewer rows there are as many blocks as a shuffle has partitions."""
_DOUBLE_BITS = 52
_CELLS = 1 << 21
"""Scores a task holds at once."""
_LOWEST = np.iinfo(np.int64).min


def quantised(embeddings: pa.Array, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Components floor(scale * x) of vectors of one width after the other, and where each vector begins."""
    lists = embeddings.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    return np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)), offsets - offsets[0]


class PackedVectors:
    """Integer vectors (rows of ``vectors``) packed so that many inner products come from one multiplication."""

    def __init__(self, vectors: np.ndarray):
        self.count = len(vectors)
        self.bias = int(vectors.min()) if vectors.size else 0
        self.vectors = vectors
        self.top = max(int(vectors.max()) - self.bias if vectors.size else 0, abs(self.bias), 1)
        self._packed: tuple[int, int, np.ndarray] | None = None

    def _words(self, bits: int) -> tuple[int, np.ndarray]:
        """Fields a word has, and words: (components, words). Field f of the words holds the f-th run of candidates."""
        if self._packed is None or self._packed[0] != bits:
            wide = bits > _DOUBLE_BITS
            fields = 8 if wide else max(_DOUBLE_BITS // bits, 1)
            per = max(-(-self.count // fields), 1)
            biased = self.vectors - float(self.bias) if not wide else np.array(
                [[int(x) - self.bias for x in v] for v in self.vectors], object).reshape(self.vectors.shape)
            words = np.zeros((self.vectors.shape[1], per), object if wide else np.float64)
            for f in range(fields):
                run = biased[f * per:(f + 1) * per]
                words[:, :len(run)] += run.T * (1 << bits * f)
            self._packed = bits, fields, words
        return self._packed[1], self._packed[2]

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products (anchors, candidates) as int64; what needs more bits becomes the nearest int64."""
        if not self.vectors.shape[1] or not len(anchors):
            return np.zeros((len(anchors), self.count), np.int64)
        whole = [sum(int(abs(x)) for x in a) for a in anchors] if np.abs(anchors).max() * anchors.shape[1] >= 2 ** 53 else np.abs(anchors).sum(1)
        bound = int(max(whole)) * self.top
        bits = (2 * bound + 1).bit_length()
        fields, words = self._words(bits)
        offset = sum(bound << bits * f for f in range(fields))
        if words.dtype == object:
            anchors = np.array([[int(x) for x in a] for a in anchors], object)
            total = anchors.dot(words) + offset
            shift = anchors.sum(1) * self.bias
        else:
            total = (anchors @ words).astype(np.int64) + offset
            shift = anchors.sum(1).astype(np.int64) * self.bias
        mask = (1 << bits) - 1
        scores = np.concatenate([(total >> bits * f) & mask for f in range(fields)], axis=1)[:, :self.count]
        scores = scores + (shift - bound)[:, None]
        if scores.dtype == object:
            scores = np.array([[min(max(x, 1 - 2 ** 63), 2 ** 63 - 1) for x in row] for row in scores], np.int64).reshape(scores.shape)
        return scores


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest allowed scores of each row, of equal ones the first; rows in order, best first."""
    n = scores.shape[1]
    bits = max(n.bit_length(), 1)
    if not n or not len(scores):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(abs(int(scores.min())), abs(int(scores.max()))) < 1 << 62 - bits:
        key = np.where(allowed, (scores << bits) + np.arange(n - 1, -1, -1), _LOWEST)
        some = np.argpartition(key, n - k, axis=1)[:, n - k:] if n > k else np.broadcast_to(np.arange(n), key.shape)
        found = np.take_along_axis(key, some, 1)
        order = np.argsort(-found, axis=1, kind="stable")
        column, real = np.take_along_axis(some, order, 1), np.take_along_axis(found, order, 1) != _LOWEST
        row = np.repeat(np.arange(len(scores)), real.sum(1))
        return row, column[real]
    rows, columns = [], []
    for r in range(len(scores)):
        order = np.argsort(-scores[r], kind="stable")
        rows.append(order[allowed[r][order]][:k])
        columns.append(np.full(len(rows[-1]), r))
    return np.concatenate(columns), np.concatenate(rows)


class _Block:
    """Candidates of one block by id, those of each width packed."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        ids = table["vec_id"].fill_null(NO_ID).combine_chunks().to_numpy(zero_copy_only=False)
        uid = table["uid"].combine_chunks().to_numpy()
        order = np.lexsort((uid, ids))
        self.uid, self.ids, self.label = uid[order], ids[order], table["label"].combine_chunks().to_numpy()[order]
        flat, offsets = quantised(table["embedding"].combine_chunks())
        width = np.diff(offsets)[order]
        self.of: dict[int, tuple[np.ndarray, PackedVectors]] = {}
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            places = offsets[:-1][order[rows]][:, None] + np.arange(w)
            self.of[w] = rows, PackedVectors(flat[places].reshape(len(rows), w))

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of anchors of one width that meet candidates: places in the batch, candidates, scores."""
        flat, offsets = quantised(batch["embedding"])
        width = np.diff(offsets)
        for w in np.unique(width).tolist():
            if w not in self.of:
                continue
            rows, packed = self.of[w]
            same = np.flatnonzero(width == w)
            step = max(_CELLS // max(len(rows), 1), 1)
            for at in range(0, len(same), step):
                some = same[at:at + step]
                anchors = flat[offsets[:-1][some][:, None] + np.arange(w)].reshape(len(some), w)
                yield some, rows, packed.products(anchors)


_FOUND = "anchor long, positive_score long, vec_id long, uid long, score long"
Choice = Callable[[_Block, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]


def _met(vectors: DataFrame, anchors: DataFrame, blocks: int, choose: Choice) -> DataFrame:
    """``choose`` on every anchor and every block of candidates. Of a partition's rows the candidates come first."""
    dealt = vectors.select(
        F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("part"), F.lit(False).alias("is_anchor"), "*", F.lit(None).cast("array<long>").alias("scores"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.lit(True).alias("is_anchor"), *vectors.columns, "scores")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, part = None, None
        for batch in batches:
            at = 0
            parts, kinds = batch["part"].to_numpy(), batch["is_anchor"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for to in [*cuts.tolist(), batch.num_rows]:
                if to == at:
                    continue
                run_of, at = batch.slice(at, to - at), to
                if run_of["part"][0].as_py() != part:
                    part, held, block = run_of["part"][0].as_py(), [], None
                if not run_of["is_anchor"][0].as_py():
                    held.append(run_of)
                    continue
                if block is None and held:
                    block, held = _Block(held), []
                if block is None:
                    continue
                for some, rows, scores in block.scored(run_of):
                    for anchor, positive, column, score in choose(block, run_of, some, rows, scores):
                        ids = block.ids[column]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(anchor, pa.int64()), pa.array(positive, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID),
                            pa.array(block.uid[column], pa.int64()), pa.array(score, pa.int64()),
                        ], ["anchor", "positive_score", "vec_id", "uid", "score"])

    both = dealt.unionByName(asked)
    return both.repartitionById(blocks, F.col("part")).sortWithinPartitions("part", "is_anchor").mapInArrow(run, _FOUND)


def _positives(k: int) -> Choice:
    def choose(block, batch, some, rows, scores):
        uid, label = batch["uid"].to_numpy()[some], batch["label"].to_numpy()[some]
        allowed = (block.label[rows] == label[:, None]) & (block.uid[rows] != uid[:, None])
        row, column = best(scores, allowed, k)
        yield uid[row], np.zeros(len(row), np.int64), rows[column], scores[row, column]

    return choose


def _negatives(k: int, floor: int) -> Choice:
    def choose(block, batch, some, rows, scores):
        uid, label = batch["uid"].to_numpy()[some], batch["label"].to_numpy()[some]
        wanted = [sorted(set(s)) for s in batch["scores"].take(pa.array(some)).to_pylist()]
        other = block.label[rows] != label[:, None]
        for nth in range(max(map(len, wanted), default=0)):
            asking = np.flatnonzero([len(w) > nth for w in wanted])
            high = np.array([wanted[a][nth] for a in asking], np.int64)
            low = np.array([-(-floor * wanted[a][nth] // 100) for a in asking], np.int64)
            seen = scores[asking]
            allowed = other[asking] & (seen >= low[:, None]) & (seen <= high[:, None])
            row, column = best(seen, allowed, k)
            yield uid[asking[row]], high[row], rows[column], seen[row, column]

    return choose


def _first(found: DataFrame, k: int, *group: str) -> DataFrame:
    """The best ``k`` of the blocks' best, with ``rank`` from 1."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def relabelled(vec_id: Column, label: Column) -> Column:
    """The label that counts: that of rows whose id is divisible by 7 moves on by one."""
    return F.when(vec_id % 7 == 0, (label.cast("long") + 1) % 10).otherwise(label.cast("long"))


def hard_negatives(
    embeddings: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 5, floor: int = 80
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of (vec_id, embedding).

    ``label`` and ``anchor`` (which rows ask) are expressions on the input. Components are floor(256 * x); a row's score is
    its inner product with the anchor, higher first, ties by the smaller vec_id. An anchor's positives are its first other rows
    of its label, the negatives of each positive the first rows of other labels that score at most as high and at least
    ``floor`` percent of it; ranks count them from 1. Pairs without a negative have no row.

    Rows without a label or vector, or with a NULL or non-finite component, take no part. Vectors of different widths don't
    meet; those of no components score 0. Repeated rows are rows of their own, so each is the other's partner and each asks.
    A NULL vec_id comes after all others. Scores beyond 64 bits count as the nearest number. Other columns are ignored.
    """
    infinite = F.lit(float("inf"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding", F.coalesce(anchor, F.lit(False)).alias("asks")
    ).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    vectors = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    columns = ["uid", "vec_id", "label", "embedding"]
    blocks = max(part_count(embeddings.sparkSession), -(-vectors.count() // BLOCK))
    asking = vectors.filter("asks").select(*columns)
    no_scores = asking.withColumn("scores", F.lit(None).cast("array<long>"))
    pairs = stage(_first(_met(vectors.select(*columns), no_scores, blocks, _positives(positives)), positives, "anchor").select(
        "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("uid").alias("positive")), "positives")
    scores = pairs.groupBy(F.col("anchor").alias("uid")).agg(F.collect_set("positive_score").alias("scores"))
    met = _met(vectors.select(*columns), asking.join(scores, "uid"), blocks, _negatives(negatives, floor))
    chosen = _first(met, negatives, "anchor", "positive_score").select(
        "anchor", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asking.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(chosen, ["anchor", "positive_score"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
