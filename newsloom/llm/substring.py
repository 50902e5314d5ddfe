"""Substring deduplication on a De Bruijn graph of word k-mers.

An edge is a window of WINDOW consecutive words, its nodes are the WINDOW - 1 words at either end. Edges are dealt out
by the smallest hash among their short k-mers (a minimizer), so that neighbouring edges of a document mostly travel and
meet their copies together. Each distinct edge keeps its first coordinate (smallest document, then smallest start); all
other places of it are repeats. Repeats that follow one another and whose sources follow one another form a path without
branches and are compacted into one span, first inside a partition, then in a join by document. A span is then sent to
its source, where the source's words are hashed with an independent hash of 64 bits. The answer goes back to the document,
which compares it with its own words, so that a span acts only where both texts really have the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.packed import (
    NO_ID, PACKED, Words, exchanged, gathered, grams, ids_of, lean, mix, pack, part_count, rows, scattered, slices, unpack,
)

WINDOW = 20
ANCHOR = 8
SLICE = 1 << 20
"""Bytes of text whose edges a task holds at once; an edge takes some twenty arrays."""
_EDGES, _SPANS = 0, 1
_INDEX_BITS = np.uint64(26)
_INDEX = np.uint64((1 << 26) - 1)
_HASH40 = np.uint64((1 << 40) - 1)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values that begin at each place (meaningless at the very end)."""
    size, low = 1, values
    while size * 2 <= width:
        low = _paired(low, size)
        size *= 2
    return _paired(low, width - size) if width > size else low


def _paired(low: np.ndarray, shift: int) -> np.ndarray:
    out = low.copy()
    np.minimum(low[:-shift], low[shift:], out=out[:-shift])
    return out


def _parts_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _span_rows(spans: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    if len(spans[0]):
        yield from scattered(_parts_of(spans[0], parts), parts, _SPANS, *spans)


def _runs(place: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs whose ``place`` rises by one and whose other columns stay."""
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.diff(place) != 1
    for column in same:
        new |= column[1:] != column[:-1]
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    return starts, np.concatenate([starts[1:], [len(place)]])


def _compact(doc, start, source, source_start, check) -> list[np.ndarray]:
    """Neighbouring repeated edges with neighbouring sources as spans: doc, start, edges, check, source, source_start."""
    at, end = _runs(start, doc, source, source_start - start)
    if not len(at):
        return [np.zeros(0, t) for t in (np.int64, np.uint32, np.uint32, np.uint64, np.int64, np.uint32)]
    return [
        doc[at], start[at].astype(np.uint32), (end - at).astype(np.uint32), np.add.reduceat(check, at),
        source[at], source_start[at].astype(np.uint32),
    ]


def _edges_of(window: int, anchor: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            ids = ids_of(batch)
            order = np.argsort(ids, kind="stable")
            batch, ids = batch.take(pa.array(order)), ids[order]
            words = Words(batch["text"])
            edge = np.flatnonzero(words.fits(window))
            if not len(edge):
                continue
            hashes = words.hashes()
            check = grams(hashes, window)[edge] & _HASH40
            index = np.arange(len(hashes), dtype=np.uint64)
            ranked = (grams(hashes, anchor) >> _INDEX_BITS << _INDEX_BITS) | (index & _INDEX)
            least = _smallest(ranked, window - anchor + 1)[edge]
            doc, start = words.doc[edge], words.place[edge]
            label = least >> _INDEX_BITS
            # Repeats inside the slice are settled here, so an edge leaves a slice once however often it occurs.
            key = mix(check ^ mix(label))
            by_key = np.argsort(key, kind="stable")
            first = np.concatenate([[True], key[by_key][1:] != key[by_key][:-1]])
            source = np.empty(len(key), np.int64)
            source[by_key] = by_key[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            own, other = ids[doc], ids[doc[source]]
            here = (source != np.arange(len(key))) & ((other < own) | (other == own) & (start[source] < start))
            yield from _span_rows(
                _compact(own[here], start[here], other[here], start[source][here], check[here]), parts)
            keep = np.flatnonzero(~here)
            near = edge[keep]
            at, end = _runs(near, doc[keep], least[keep])
            if not len(at):
                continue
            lead = keep[at]
            # A group of edges with one anchor: document, start, count, label; and its edges' hashes, five bytes each.
            part = (label[lead] % np.uint64(parts)).astype(np.int64)
            by_part = np.argsort(part, kind="stable")
            count = (end - at)[by_part]
            bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
            begin = np.concatenate([[0], np.cumsum(count)])
            flat = np.repeat(at[by_part] - begin[:-1], count) + np.arange(begin[-1])
            moved = check[keep[flat]]
            lead = lead[by_part]
            labels = (mix(label[lead]) >> np.uint64(32)).astype(np.uint32)
            out: tuple[list, list, list] = ([], [], [])
            for p in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[p], bounds[p + 1]
                mine = lead[a:b]
                known, local = np.unique(doc[mine], return_inverse=True)
                body = moved[begin[a]:begin[b]]
                out[0].append(int(p))
                out[1].append(_EDGES)
                out[2].append(pack(
                    ids[known], local.astype(np.uint16 if len(known) < 1 << 16 else np.uint32), start[mine].astype(np.uint32),
                    count[a:b].astype(np.uint8 if window - anchor < 250 else np.uint32), labels[a:b],
                    body.astype(np.uint32), (body >> np.uint64(32)).astype(np.uint8),
                ))
                if len(out[0]) >= 128:
                    yield rows(*out)
                    out = ([], [], [])
            if out[0]:
                yield rows(*out)

    return run


def _repeated(key: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once, sorted range by range to hold little at a time."""
    out = []
    for top in range(8):
        some = np.flatnonzero(key >> np.uint64(61) == np.uint64(top))
        own = key[some]
        order = np.argsort(own)
        own = own[order]
        same = own[1:] == own[:-1]
        out.append(some[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(some) else some)
    return np.concatenate(out)


def _repeats(parts: int):
    """Edges of one partition: spans of those whose first place is elsewhere. Spans that pass through stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            passing = ([], [], [])
            for kind, data in zip(batch["kind"].to_pylist(), batch["data"], strict=True):
                if kind == _EDGES:
                    found.append(unpack(data.as_py()))
                    continue
                spans = unpack(data.as_py())
                yield from _span_rows(spans, parts)
            del passing
        if not found:
            return
        owner = np.concatenate([ids[local] for ids, local, *_ in found])
        start, count, label, low, high = (np.concatenate([f[k] for f in found]) for k in range(2, 7))
        found.clear()
        check = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        del low, high
        count = count.astype(np.int64)
        group = np.repeat(np.arange(len(count), dtype=np.int32), count)
        key = mix(check ^ mix(label.astype(np.uint64))[group])
        order = _repeated(key)
        if not len(order):
            return
        begin = start.astype(np.int64) - np.cumsum(count) + count
        owner, place, key, check = owner[group[order]], begin[group[order]] + order, key[order], check[order]
        del group
        order = np.lexsort((place, owner, key))
        doc, begin, key, check = owner[order], place[order], key[order], check[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        source = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        repeat = np.flatnonzero((doc[source] != doc) | (begin[source] != begin))
        doc, begin, src, src_begin, check = (
            doc[repeat], begin[repeat], doc[source[repeat]], begin[source[repeat]], check[repeat])
        back = np.lexsort((begin, doc))
        yield from _span_rows(_compact(doc[back], begin[back], src[back], src_begin[back], check[back]), parts)

    return run


SPANS = "doc_id long, spans binary"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one partition of documents, joined end to end where their sources also follow; a row per document."""
    found = list(gathered(batches, _SPANS))
    if not found:
        return
    doc, start, count, check, source, source_start = (np.concatenate([f[k] for f in found]) for k in range(6))
    found.clear()
    order = np.lexsort((start, doc))
    doc, start, count, check, source, source_start = (
        x[order] for x in (doc, start.astype(np.int64), count.astype(np.int64), check, source, source_start.astype(np.int64)))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])
                          | (start[1:] != start[:-1] + count[:-1]) | (source_start[1:] != source_start[:-1] + count[:-1])])
    at = np.flatnonzero(new)
    doc, start, source, source_start = doc[at], start[at], source[at], source_start[at]
    count, check = np.add.reduceat(count, at), np.add.reduceat(check, at)
    bounds = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
    for i in range(0, len(bounds) - 1, 1024):
        some = bounds[i:i + 1025]
        yield pa.RecordBatch.from_arrays([
            pa.array(doc[some[:-1]], pa.int64()),
            pa.array([pack(*(c[a:b] for c in (start, count, check, source, source_start)))
                      for a, b in zip(some[:-1], some[1:], strict=True)], pa.binary()),
        ], ["doc_id", "spans"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """A row for each document that repeats something: doc_id and its packed spans (start, edges, check, source, source_start).

    A span of n edges covers n + ``window`` - 1 words. Sources are first places. A missing id stands as NO_ID.
    """
    parts = part_count(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    edges = exchanged(texts.mapInArrow(lean(_edges_of(window, anchor, parts)), PACKED), parts)
    return exchanged(edges.mapInArrow(lean(_repeats(parts)), PACKED), parts).mapInArrow(lean(_paths), SPANS)


def span_table(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The spans as rows: doc_id, start, n_words, source_id, source_start (in words); NULL ids come back as NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, packed in zip(ids_of(batch), batch["spans"], strict=True):
                start, count, _, source, source_start = unpack(packed.as_py())
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if doc == NO_ID else int(doc)] * len(start), pa.int64()), pa.array(start, pa.int64()),
                    pa.array(count + window - 1, pa.int64()), pa.array(source, pa.int64(), mask=source == NO_ID),
                    pa.array(source_start, pa.int64()),
                ], ["doc_id", "start", "n_words", "source_id", "source_start"])

    return repeated_spans(docs, window, anchor).mapInArrow(
        lean(run), "doc_id long, start long, n_words long, source_id long, source_start long")


_ASKS_A_ROW = 1 << 16


def _wide(words: Words, window: int) -> np.ndarray:
    """Running sums of a hash of each window that has nothing in common with the one that found the repeats."""
    return np.concatenate([[np.uint64(0)], np.cumsum(mix(grams(mix(words.hashes() ^ np.uint64(0x6A09E667F3BCC909)), window)))])


def _asked(parts: int):
    """Spans sent to the documents they name as sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spans = [unpack(s.as_py()) for s in batch["spans"]]
                doc = np.repeat(batch["doc_id"].to_numpy(), [len(s[0]) for s in spans])
                start, count, _, source, source_start = (np.concatenate([s[k] for s in spans]) for k in range(5))
                yield from scattered(_parts_of(source, parts), parts, _SPANS, source, source_start, count, doc, start)

    return run


def _grouped(most: int):
    """Spans of one partition in rows of one document (the first column), at most ``most`` in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(gathered(batches, _SPANS))
        if not found:
            return
        columns = [np.concatenate([f[k] for f in found]) for k in range(len(found[0]))]
        found.clear()
        order = np.argsort(columns[0], kind="stable")
        of, *columns = (c[order] for c in columns)
        nth = np.arange(len(of))
        first = np.concatenate([[True], of[1:] != of[:-1]])
        nth -= np.maximum.accumulate(np.where(first, nth, 0))
        bounds = np.concatenate([np.flatnonzero(nth % most == 0), [len(of)]])
        for i in range(0, len(bounds) - 1, 256):
            some = bounds[i:i + 257]
            yield pa.RecordBatch.from_arrays([
                pa.array(of[some[:-1]], pa.int64()),
                pa.array([pack(*(c[a:b] for c in columns)) for a, b in zip(some[:-1], some[1:], strict=True)], pa.binary()),
            ], ["doc_id", "spans"])

    return run


def _answered(window: int, parts: int):
    """The source's hash of each span, sent back to the document that has the span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch["text"])
            wide, out = _wide(words, window), []
            for d, (of, packed) in enumerate(zip(batch["_of"].to_pylist(), batch["spans"], strict=True)):
                source_start, count, doc, start = unpack(packed.as_py())
                fits = source_start + count + window - 1 <= words.counts[d]
                source_start, count, doc, start = source_start[fits], count[fits], doc[fits], start[fits]
                at = source_start + words.first[d]
                out.append((doc, start, count, wide[at + count] - wide[at], np.full(len(doc), of, np.int64), source_start))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield from scattered(_parts_of(columns[0], parts), parts, _SPANS, *columns)

    return run


def verified_spans(keyed: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The spans with their sources' hash as check. ``keyed`` has _key and text; a span whose source is too short is left out.

    Where several rows share the source's id, each answers.
    """
    parts = part_count(keyed.sparkSession)
    asks = exchanged(spans.mapInArrow(lean(_asked(parts)), PACKED), parts).mapInArrow(lean(_grouped(_ASKS_A_ROW)), SPANS).withColumnRenamed("doc_id", "_of")
    met = keyed.select("_key", "text").join(asks, F.col("_key") == F.col("_of")).select("_of", "text", "spans")
    return exchanged(met.mapInArrow(lean(_answered(window, parts)), PACKED), parts).mapInArrow(lean(_grouped(NO_ID)), SPANS)


def _removed(words: Words, spans: list[bytes | None], window: int) -> np.ndarray:
    """Which words the documents' spans cover, as far as the sources really have the same words."""
    n = len(words.starts)
    change = np.zeros(n + 1, np.int32)
    if any(s is not None for s in spans):
        check = _wide(words, window)
        for d, packed in enumerate(spans):
            if packed is None:
                continue
            start, count, sums, *_ = unpack(packed)
            fits = start + count + window - 1 <= words.counts[d]
            start, count, sums = start[fits] + words.first[d], count[fits], sums[fits]
            real = check[start + count] - check[start] == sums
            np.add.at(change, start[real], 1)
            np.add.at(change, (start + count + window - 1)[real], -1)
    return np.cumsum(change[:n]) > 0


def _applied(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch["text"])
            gone = _removed(words, batch["spans"].to_pylist(), window)
            counts = np.concatenate([[0], np.cumsum(gone)])
            removed = counts[words.first[1:]] - counts[words.first[:-1]]
            # Bytes of kept words, and one separator after each kept word but the last of its document.
            keep = words.inside.copy()
            cut = np.flatnonzero(gone)
            if len(cut):
                edge = np.zeros(len(keep) + 1, np.int32)
                np.add.at(edge, words.starts[cut], 1)
                np.add.at(edge, words.ends[cut], -1)
                keep &= np.cumsum(edge[:-1]) == 0
            stay = np.flatnonzero(~gone)
            inner = stay[:-1][words.doc[stay[:-1]] == words.doc[stay[1:]]]
            keep[words.ends[inner]] = True
            body = np.where(words.inside, words.data, np.uint8(0x20))[keep].tobytes()
            bounds = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
            texts = [body[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch["doc_id"], pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64())]
            names = ["doc_id", "n_words", "n_removed"]
            if with_text:
                old = batch["text"].to_pylist()
                columns.append(pa.array([t.decode() if r else o for t, r, o in zip(texts, removed, old, strict=True)], pa.string()))
                rest = [c for c in batch.schema.names if c not in ("doc_id", "text", "spans", "_key", "_of")]
                columns += [batch[c] for c in rest]
                yield pa.RecordBatch.from_arrays(columns, [*names, "text", *rest])
            else:
                columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, "kept_sha256"])

    return run


def _with_spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    spans = verified_spans(keyed, repeated_spans(docs, window, anchor), window).withColumnRenamed("doc_id", "_of")
    return keyed.join(spans, F.col("_key") == F.col("_of"), "left").drop("_key", "_of")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space, UTF-8).

    A word goes when a window of ``window`` words of one document covers it whose words also begin earlier: in a
    smaller doc_id, or earlier in the same document. Windows are judged on the input. NULL and empty texts have no
    words. Rows that share an id count as one document: equal rows are judged alike and do not remove each other;
    a NULL id comes after all others. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(docs, window, anchor).select("doc_id", "text", "spans").mapInArrow(
        lean(_applied(window, False)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The same rows and columns; texts that repeat something lose it and keep their other words joined by one space."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    schema = "doc_id long, n_words long, n_removed long, text string" + "".join(
        f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    done = _with_spans(inner.withColumn("doc_id", F.col("doc_id").cast("long")), window, anchor).select(
        "doc_id", "text", *[f"c{i}" for i in range(len(others))], "spans").mapInArrow(lean(_applied(window, True)), schema)
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(others)}
    return done.select(*[back.get(c, F.col(c)) for c in docs.columns])
