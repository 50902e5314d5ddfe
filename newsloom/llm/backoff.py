"""Language-model scores by stupid backoff, with n-gram counts of a corpus.

The score of a word w after u, v is c(uvw) / c(uv). A document begins with two start marks, so every word has a context.
Where the counted corpus does not have uvw, the score is FACTOR * c(vw) / c(v), and where it does not have vw either,
FACTOR ** 2 * c(w) / (all words). n-grams of a corpus of its own are counted in all orders and joined with the n-grams of the
documents.

Where the documents that are scored are those that are counted, each n-gram of a document is in the table, and backing off
is never reached. So the logarithm of a document's score is a sum of logarithms of trigram counts less a sum of
logarithms of context counts, and both tables are handled alike: n-grams are dealt out by
hash, counted where they meet, and what they add to a document goes back to the slice of documents it came from.

An n-gram that many documents of a slice have leaves it once, with its total, and its answer is spread over the documents
when it is back. So no n-gram costs more than one record a slice, whatever share of the documents has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.packed import PACKED, Words, exchanged, grams, ids_of, mix, pack, part_count, rows, slices, unpack

HOT = 32
"""Documents of a slice from which on an n-gram is sent once for all of them."""
ORDER = 3
FACTOR = 0.4
_START = np.uint64(0x243F6A8885A308D3)
_GRAMS, _DOCS, _HOT, _SUMS, _ANSWERS = 0, 1, 2, 3, 4
_U = np.uint64
_HASH40 = _U((1 << 40) - 1)


def _padded(words: Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes with ``order`` - 1 start marks before each document, where each n-gram begins, and its document."""
    lead = order - 1
    out = np.full(len(words.starts) + lead * len(words.counts), _START, _U)
    at = np.arange(len(words.starts)) + lead * (words.doc + 1)
    out[at] = words.hashes()
    return out, at - lead, words.doc


def _home(name: np.ndarray, parts: int) -> int:
    """The partition where a slice's answers meet. Names are task and number, so they are mixed first."""
    return int(mix(name.astype(_U))[0] % _U(parts))


def _sent(parts: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches)):
            name = np.array([task << 24 | number], np.int64)
            home = _home(name, parts)
            words = Words(batch["text"])
            absent = batch["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            yield rows([home], [_DOCS], [pack(name, ids_of(batch), absent, words.counts.astype(np.int64))])
            if not len(words.starts):
                continue
            padded, begin, doc = _padded(words, order)
            for size in (order, order - 1):
                gram = grams(padded, size)[begin]
                by = np.lexsort((doc, gram))
                g, d = gram[by], doc[by]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.concatenate([at, [len(g)]]))
                g, d = g[at], d[at]
                lists = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
                which = np.repeat(np.arange(len(lists) - 1), np.diff(lists))
                hot = np.diff(lists) >= HOT
                few = ~hot[which]
                yield from _packed(name, size, parts, _GRAMS, g[few], d[few], count[few])
                if hot.any():
                    nth = np.cumsum(hot) - 1
                    total = np.add.reduceat(count, lists[:-1])[hot]
                    yield from _packed(name, size, parts, _HOT, g[lists[:-1]][hot], np.arange(len(total)), total)
                    many = hot[which]
                    yield rows([home], [_HOT], [pack(
                        name, np.array([-size]), nth[which[many]].astype(np.uint32), d[many].astype(np.uint32), count[many].astype(np.uint32))])

    return run


def _packed(name: np.ndarray, size: int, parts: int, kind: int, gram: np.ndarray, owner: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slice, order, hash in five bytes, document (or number of the hot n-gram) and count, by part."""
    part = (gram % _U(parts)).astype(np.int64)
    order = np.lexsort((owner, part))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    short = ((gram >> _U(20)) & _HASH40)[order]
    owner, count = owner[order], count[order]
    narrow = np.uint16 if len(owner) and owner.max() < 1 << 16 else np.uint32
    full = np.flatnonzero(np.diff(bounds))
    for i in range(0, len(full), 128):
        some = full[i:i + 128]
        yield rows(some.tolist(), [kind] * len(some), [pack(
            name, np.array([size]), short[a:b].astype(np.uint32), (short[a:b] >> _U(32)).astype(np.uint8),
            owner[a:b].astype(narrow), count[a:b].astype(np.uint32)) for a, b in zip(bounds[some], bounds[some + 1], strict=True)])


def _counted(parts: int, order: int):
    """Counts of the n-grams of one partition, and what they add to the documents of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {order: [], order - 1: []}
        for batch in batches:
            for part, kind, data in zip(batch["part"].to_pylist(), batch["kind"].to_pylist(), batch["data"], strict=True):
                body = data.as_py()
                columns = unpack(body) if kind != _DOCS else None
                if columns is None or columns[1][0] < 0:
                    yield rows([part], [kind], [body])
                else:
                    found[int(columns[1][0])].append((kind, *columns))
        for size, pieces in found.items():
            if not pieces:
                continue
            sign = 1.0 if size == order else -1.0
            h = np.concatenate([p[3].astype(_U) | p[4].astype(_U) << _U(32) for p in pieces])
            count = np.concatenate([p[6] for p in pieces])
            by = np.argsort(h)
            at = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
            total = np.add.reduceat(count[by].astype(np.int64), at)
            value = np.empty(len(h))
            value[by] = np.repeat(sign * np.log(total), np.diff(np.concatenate([at, [len(h)]])))
            del h, by
            to = 0
            for kind, name, _, _, _, owner, count in pieces:
                mine = value[to:to + len(owner)]
                to += len(owner)
                home = _home(name, parts)
                if kind == _HOT:
                    yield rows([home], [_ANSWERS], [pack(name, np.array([size]), owner.astype(np.uint32), mine)])
                    continue
                known = np.flatnonzero(np.diff(owner.astype(np.int64), prepend=-1))
                sums = np.add.reduceat(mine * count, known)
                some = np.flatnonzero(sums)
                if len(some):
                    yield rows([home], [_SUMS], [pack(name, owner[known][some], sums[some])])

    return run


_SCORES = "doc_id long, n_words long, log_score double"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of the slices that belong to one partition."""
    docs, sums, hot, answers = {}, {}, {}, {}
    for batch in batches:
        for kind, data in zip(batch["kind"].to_pylist(), batch["data"], strict=True):
            name, *columns = unpack(data.as_py())
            name = int(name[0])
            if kind == _DOCS:
                docs[name] = columns
            elif kind == _SUMS:
                sums.setdefault(name, []).append(columns)
            elif kind == _HOT:
                hot.setdefault(name, []).append(columns)
            else:
                answers.setdefault((name, int(columns[0][0])), []).append(columns[1:])
    for name, (ids, absent, n) in docs.items():
        total = np.zeros(len(ids))
        for owner, value in sums.get(name, []):
            total[owner] += value
        for size, nth, doc, count in hot.get(name, []):
            value = np.zeros(int(nth.max()) + 1)
            for at, some in answers.get((name, -int(size[0])), []):
                value[at] = some
            total += np.bincount(doc, value[nth] * count, len(ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=absent.astype(bool)), pa.array(n), pa.array(total, mask=n == 0)], ["doc_id", "n_words", "log_score"])


def _keys(words: Words, order: int) -> list[np.ndarray]:
    """For each word a key of its n-gram and one of that n-gram's context, from ``order`` down; the last is the word alone."""
    padded, begin, _ = _padded(words, order)
    keys = []
    for size in range(order, 0, -1):
        at = begin + order - size
        keys.append(mix(grams(padded, size)[at] + _U(2 * size)))
        if size > 1:
            keys.append(mix(grams(padded, size - 1)[at] + _U(2 * size + 1)))
    return keys


def _table(order: int):
    """(key, count) of every order, summed per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch["text"])
            if len(words.starts):
                for keys in _keys(words, order):
                    key, count = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["key", "count"])

    return run


_ASKED = "row long, doc_id long, n_words long, gram long, times long, keys array<long>"


def _asked(order: int):
    """A row for each distinct n-gram of a document, with how often it occurs and its keys; a text without words has one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, past = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            words = Words(batch["text"])
            doc, keys = words.doc, np.zeros((0, 2 * order - 1), np.int64)
            if len(words.starts):
                keys = np.stack(_keys(words, order), axis=1).view(np.int64)
            by = np.lexsort((keys[:, 0], doc))
            doc, keys = doc[by], keys[by]
            at = np.flatnonzero(np.concatenate([np.ones(min(len(doc), 1), bool), (doc[1:] != doc[:-1]) | (keys[1:, 0] != keys[:-1, 0])]))
            times = np.diff(np.concatenate([at, [len(doc)]]))
            none = np.flatnonzero(words.counts == 0)
            owner = np.concatenate([doc[at], none])
            flat = np.concatenate([keys[at], np.zeros((len(none), keys.shape[1]), np.int64)])
            absent = np.arange(len(owner)) >= len(at)
            times = np.concatenate([times, np.zeros(len(none), np.int64)])
            ids = batch["doc_id"].cast(pa.int64()).take(pa.array(owner))
            for i in range(0, len(owner), 16_384):
                o = slice(i, i + 16_384)
                body = flat[o]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(body) + 1) * body.shape[1], pa.int32()), pa.array(body.ravel()))
                yield pa.RecordBatch.from_arrays([
                    pa.array((task << 40) + past + owner[o]), ids[o], pa.array(words.counts[owner[o]].astype(np.int64)),
                    pa.array(body[:, 0], mask=absent[o]), pa.array(times[o].astype(np.int64)), lists,
                ], ["row", "doc_id", "n_words", "gram", "times", "keys"])
            past += len(words.counts)

    return run


def _scored(docs: DataFrame, counted: DataFrame, order: int, factor: float) -> DataFrame:
    table = counted.mapInArrow(_table(order), "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
    words = counted.mapInArrow(_word_count, "words long").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    asked = docs.mapInArrow(_asked(order), _ASKED).select("row", "doc_id", "n_words", "gram", "times", F.posexplode("keys").alias("level", "key"))
    last = 2 * order - 2
    met = asked.join(table, "key", "left").groupBy("row", "gram").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_words", "times")],
        *[F.max(F.when(F.col("level") == k, F.col("count"))).alias(f"c{k}") for k in range(last + 1)]).crossJoin(F.broadcast(words))
    # A word that the corpus does not have stands as if it occurred once.
    score = F.log(F.coalesce(f"c{last}", F.lit(1))) - F.log(F.greatest("words", F.lit(1))) + F.lit((order - 1) * math.log(factor))
    for k in range(last - 2, -1, -2):
        score = F.when(F.col(f"c{k}").isNotNull(), F.log(f"c{k}") - F.log(f"c{k + 1}") + F.lit(k // 2 * math.log(factor))).otherwise(score)
    return met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sum(F.when(F.col("gram").isNotNull(), score * F.col("times"))).alias("log_score")).drop("row")


def _word_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([len(Words(batch["text"]).starts)], pa.int64())], ["words"])


def backoff_scores(docs: DataFrame, order: int = ORDER, counted: DataFrame | None = None, factor: float = FACTOR) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, log_score (sum of natural logarithms) and mean_log_score (per word).

    Words are ``[^\\x20\\x09-\\x0D]+``. Every whole text counts, repeated rows as often as they occur. NULL and empty
    texts have no words and NULL scores. A hash has 40 bits and those of its partition, so a few in a million n-grams of
    a very large corpus share a count. Other columns are ignored.

    ``counted`` is the corpus (text) whose n-grams are counted, ``docs`` unless given. An n-gram that it doesn't have backs off
    to shorter ones, each step times ``factor``; a word that it doesn't have stands as if it occurred once.
    """
    parts = part_count(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if counted is not None:
        return _scored(docs, counted.select(F.col("text").cast("string").alias("text")), order, factor).withColumn(
            "mean_log_score", F.col("log_score") / F.col("n_words"))
    sent = exchanged(docs.mapInArrow(_sent(parts, order), PACKED), parts)
    back = exchanged(sent.mapInArrow(_counted(parts, order), PACKED), parts)
    return back.mapInArrow(_gathered, _SCORES).withColumn("mean_log_score", F.col("log_score") / F.col("n_words"))
