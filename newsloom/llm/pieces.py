"""SentencePiece encoding and decoding of BPE models, many words at once.

The public model is a BPE model: its pieces come from merging the best neighbouring pair again and again, which the
best path of a Viterbi search over piece scores does not give. So words of equal length advance together through the
merges: hashes of joined substrings probe the sorted piece keys, a vectorised maximum finds each word's best pair, and
the boundaries left over are the pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.packed import Words, slices
from newsloom.llm.tokens import WordTokens

MARK = "▁"
LONG = 64
"""Words of more characters are merged with a heap, one by one."""
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = -np.inf
_models: dict[str, PieceModel] = {}


class Units(Words):
    """Texts cut where no piece can cross: before a run of spaces, and around tabs and line feeds.

    Every text that is not empty gets the space in front that the model adds.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.replace_substring(texts.fill_null("").cast(pa.string()), MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
        super().__init__(texts)
        space, control = self.data == 0x20, (self.data == 0x09) | (self.data == 0x0A)
        n = len(self.data)
        cut = np.zeros(n + 1, bool)
        cut[self.bounds] = True
        cut[1:n] |= (space[1:] & ~space[:-1]) | control[1:] | control[:-1]
        cut[0] = cut[n] = True
        at = np.flatnonzero(cut)
        self.starts, self.ends = (at[:-1], at[1:]) if n else (at[:0], at[:0])
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.starts)) - self.first[self.doc]


class PieceModel(WordTokens):
    """Piece ids of units seen so far; see :class:`WordTokens` for how they are kept."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.library
        everything = range(m.get_piece_size())
        self.pieces = [m.id_to_piece(i) for i in everything]
        plain = [i for i in everything if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if any(c in self.pieces[i] for i in plain for c in "\t\n"):
            raise ValueError("a piece with a tab or line feed")
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece that goes on after a space")
        self.id = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: m.get_score(i) for i in plain}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = m.unk_id()
        self.longest = max(len(p) for p in self.id)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(LONG + 1, _BASE, np.uint64))])
        keys = np.array([self._hash(p) for p in self.id], np.uint64)
        order = np.argsort(keys)
        self.keys_of = keys[order]
        self.id_of = np.array(list(self.id.values()), np.int64)[order]
        self.score_of = np.array([self.scores[p] for p in self.id])[order]
        as_byte = {self.bytes[b]: bytes([b]) for b in range(256) if self.bytes[b] != self.unknown}
        self.text = [as_byte.get(i, b"" if m.is_control(i) else b" \xe2\x81\x87 " if m.is_unknown(i)
                                 else self.pieces[i].replace(MARK, " ").encode()) for i in everything]
        self._forget()

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def _hash(self, piece: str) -> int:
        total = 0
        for c in piece:
            total = (total * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return total

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the sorted piece keys, -1 where it is no piece."""
        at = np.minimum(np.searchsorted(self.keys_of, h), len(self.keys_of) - 1)
        return np.where(self.keys_of[at] == h, at, -1)

    def _score(self, h: np.ndarray) -> np.ndarray:
        at = self._probe(h)
        return np.where(at >= 0, self.score_of[at], _NONE)

    def _merged(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of units of one length, and their piece places (-1: no piece), as soon as nothing is left to merge."""
        n = points.shape[1]
        total = np.zeros((len(points), n + 1), np.uint64)
        for k in range(n):
            total[:, k + 1] = total[:, k] * _BASE + points[:, k] + np.uint64(1)
        row = np.arange(len(points))
        edge = np.tile(np.arange(n + 1), (len(points), 1))

        def joined(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return total[rows, b] - total[rows, a] * self.power[b - a]

        score = self._score(joined(row[:, None], edge[:, :-2], edge[:, 2:])) if n > 1 else np.zeros((len(points), 0))
        while len(row):
            m = edge.shape[1] - 1
            best = score.argmax(1) if m > 1 else np.zeros(len(row), np.int64)
            more = score[np.arange(len(row)), best] > _NONE if m > 1 else np.zeros(len(row), bool)
            if not more.all():
                done = ~more
                yield row[done], self._probe(joined(row[done][:, None], edge[done][:, :-1], edge[done][:, 1:]))
                row, edge, score, best = row[more], edge[more], score[more], best[more]
            if not len(row):
                return
            i = np.arange(len(row))
            edge = edge[np.arange(m + 1) != best[:, None] + 1].reshape(len(row), m)
            score = score[np.arange(m - 1) != best[:, None]].reshape(len(row), m - 2)
            for shift in (-1, 0):
                k = best + shift
                good = (k >= 0) & (k < m - 2)
                k = k[good]
                score[i[good], k] = self._score(joined(row[good], edge[i[good], k], edge[i[good], k + 2]))

    def _long(self, unit: str) -> list[str]:
        """The pieces of a long unit: the best pair of all, the leftmost of equals, again and again."""
        part: list[str] = list(unit)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            j = right[i]
            if j < len(part) and len(part[i]) + len(part[j]) <= self.longest and (s := self.scores.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, part[i] + part[j]))

        for i in range(len(part) - 1):
            push(i)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if not part[i] or not part[j] or right[i] != j or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, ""
            right[i] = right[j]
            if right[i] < len(part):
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [p for p in part if p]

    def _id_list(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            known = self.id.get(p)
            if known is not None:
                out.append(known)
            else:
                out += [self.bytes[b] for b in p.encode()]
        return out

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and flat ids of units; units of one length go through the merges together."""
        units = [w.replace(" ", MARK) for w in words]
        ids: list = [None] * len(units)
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by.setdefault(len(u), []).append(i)
        for n, some in by.items():
            if n > LONG:
                for i in some:
                    ids[i] = self._id_list(self._long(units[i]))
                continue
            for k in range(0, len(some), 16_384):
                block = some[k:k + 16_384]
                points = np.frombuffer("".join(units[i] for i in block).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
                for row, place in self._merged(points):
                    known = self.id_of[place]
                    whole = (place >= 0).all(1)
                    for r, x, good in zip(row.tolist(), known.tolist(), whole.tolist(), strict=True):
                        ids[block[r]] = x if good else None
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = self._id_list(self._long(units[i]))
        sizes = np.array([len(x) for x in ids], np.int32)
        return sizes, np.fromiter((t for x in ids for t in x), np.uint32, int(sizes.sum()))

    def decoded(self, ids: np.ndarray) -> str:
        """The text of piece ids, without the space that encoding put in front."""
        body = b"".join(map(self.text.__getitem__, ids.tolist()))
        return (body[1:] if body[:1] == b" " else body).decode("utf-8", "replace")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Per row of (doc_id, text): doc_id and ids (array of int), as the library encodes the text without extra ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for batch in slices(batches):
            ids, bounds = pieces.ids(Units(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, model: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and text. NULL ids give NULL; white-space marks come back as spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for batch in batches:
            texts = [None if x is None else pieces.decoded(np.array(x, np.int64)) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def piece_counts(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_pieces, ids_crc32 (unsigned little-endian 32-bit ids), round_trip.

    ``round_trip`` says whether the decoded text is the text, with U+2581 as a space, which is what the model makes of it.
    NULL counts as empty; empty texts have no pieces. Nothing is shuffled. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for batch in slices(batches):
            texts = batch["text"].fill_null("")
            ids, bounds = pieces.ids(Units(texts))
            view = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            crc, same = [], []
            for text, a, b in zip(texts.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                crc.append(zlib.crc32(view[4 * a:4 * b]))
                same.append(pieces.decoded(ids[a:b]) == text.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)],
                ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
