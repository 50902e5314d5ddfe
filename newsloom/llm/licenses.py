"""License notices in texts, also with a few wrong letters.

A notice may be met with up to ``edits`` inserted, deleted or replaced characters. It is cut into ``edits`` + 1 pieces; by the
pigeonhole principle one of them stands in the text unchanged, so only the surroundings of exact pieces are looked at. There
the regex library's bounded-error matching decides, and gives the span and the number of edits. Matching runs over the words
of a text joined by one space, and a span begins and ends with whole words. No row is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.packed import slices

# The phrases that count as they stand, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


class Notice(NamedTuple):
    """A short notice (lower-case words, one space between them), its label, and how many characters may differ."""

    text: str
    label: str
    edits: int


def notice(text: str, label: str) -> Notice:
    """An edit for each full eight characters, three at most: pieces keep four characters and more."""
    return Notice(text, label, min(3, len(text) // 8))


NOTICES = tuple(notice(*n) for n in (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license", "apache"),
    ("creative commons attribution", "cc-by"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("mozilla public license", "mpl"),
    ("3 clause bsd license", "bsd"),
))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACE, _END = 0x20, 0x0A


class Match(NamedTuple):
    """A notice found in a slice: text, first and last word (of that text), edits, the words as they stand."""

    doc: int
    notice: int
    first: int
    last: int
    edits: int
    found: str


class Normalised:
    """The lower-case words of a slice of texts joined by one space; a line end closes each text's last word."""

    def __init__(self, texts: pa.Array):
        filled = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
        body = filled.buffers()[2]
        size = int(offsets[-1] - offsets[0])
        data = _LOWER[np.frombuffer(body, np.uint8, size, int(offsets[0]))] if size else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        inside, cut = _WORD[data], np.zeros(size + 1, bool)
        cut[bounds] = True
        starts = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])[:size]))
        ends = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]])[:size])) + 1
        self.first = np.searchsorted(starts, bounds)
        """Index of each text's first word; the last entry is the number of words."""
        length = ends - starts + 1
        self.begin = np.cumsum(length) - length
        """Where each word begins in ``body``."""
        source = np.repeat(starts - self.begin, length) + np.arange(int(length.sum()))
        joined = data[np.minimum(source, max(size - 1, 0))] if size else data
        if len(starts):
            joined[self.begin + length - 1] = _SPACE
            last = self.first[1:][np.diff(self.first) > 0] - 1
            joined[self.begin[last] + length[last] - 1] = _END
        self.body = joined.tobytes()
        self.bounds = np.concatenate([self.begin, [len(self.body)]])[self.first]
        """Where each text begins in ``body``."""

    def places(self, seed: bytes) -> Iterator[int]:
        at = self.body.find(seed)
        while at >= 0:
            yield at
            at = self.body.find(seed, at + 1)

    def closed(self, at: int) -> bool:
        """Whether no word goes on at this byte: the byte is between words, or outside."""
        return not 0 <= at < len(self.body) or self.body[at] in (_SPACE, _END)

    def character(self, at: int) -> int:
        """The first byte from here that begins a character."""
        while 0x80 <= self.body[at] < 0xC0:
            at += 1
        return at

    def word(self, at: int) -> int:
        return int(np.searchsorted(self.begin, at, "right")) - 1

    def doc(self, at: int) -> int:
        return int(np.searchsorted(self.bounds, at, "right")) - 1


def pieces(found: Notice) -> list[tuple[int, bytes]]:
    """``edits`` + 1 pieces of about one length, each with its place in the notice."""
    cuts = [len(found.text) * k // (found.edits + 1) for k in range(found.edits + 2)]
    return [(a, found.text[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _verifier(found: Notice) -> Callable[[str], list[tuple[int, int, int]]]:
    """Best match in a piece of text that has one more character on both sides: start, end and edits, or nothing.

    What stands before and after has to be a space, so a match has whole words.
    """
    pattern = regex.compile(f"(?<= )(?:{regex.escape(found.text, special_only=True)}){{e<={found.edits}}}(?= )", regex.BESTMATCH)

    @lru_cache(maxsize=1 << 14)
    def verified(window: str) -> tuple[int, int, int] | None:
        match = pattern.search(window)
        return match and (match.start(), match.end(), sum(match.fuzzy_counts))

    return verified


class Scanner:
    """Exact places of phrases and bounded-error matches of notices."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[Notice] = NOTICES):
        for n in notices:
            if len(n.text) // (n.edits + 1) < 1 or not n.text.isascii() or " ".join(n.text.lower().split()) != n.text:
                raise ValueError(f"not a notice in lower-case words with fewer edits than characters: {n}")
        self.phrases, self.notices = tuple(phrases), tuple(notices)
        self.verifiers = [_verifier(n) for n in self.notices]

    def base(self, text: Normalised) -> Iterator[tuple[int, int, int]]:
        """Every place of every phrase: phrase, text, first word."""
        for k, (phrase, _) in enumerate(self.phrases):
            for at in text.places(phrase.encode()):
                if text.closed(at - 1) and text.closed(at + len(phrase)):
                    doc = text.doc(at)
                    yield k, doc, text.word(at) - int(text.first[doc])

    def matches(self, text: Normalised) -> Iterator[Match]:
        """Matches of every notice. Of overlapping ones of a notice the one with the fewest edits, then the first, counts."""
        for k, n in enumerate(self.notices):
            margin, windows = 4 * n.edits, set()  # an edit moves what follows by at most a character of four bytes
            for offset, seed in pieces(n):
                for at in text.places(seed):
                    doc = text.doc(at)
                    low = max(at - offset - margin, int(text.bounds[doc]))
                    high = min(at - offset + len(n.text) + margin, int(text.bounds[doc + 1]) - 1)
                    windows.add((text.character(low), text.character(high)))
            spans = set()
            for low, high in windows:
                left, right = (" " if text.closed(at) else "x" for at in (low - 1, high))
                found = self.verifiers[k](left + text.body[low:high].decode() + right)
                if found:
                    spans.add((low, high, *found))
            yield from self._best(text, k, spans)

    def _best(self, text: Normalised, k: int, spans: set[tuple[int, int, int, int, int]]) -> Iterator[Match]:
        found = []
        for low, high, start, end, edits in spans:
            window = text.body[low:high].decode()
            begin, match = low + len(window[:start - 1].encode()), window[start - 1:end - 1]
            found.append((begin, begin + len(match.encode()), edits, match))
        chain: list[tuple[int, int, int, str]] = []
        reach = -1
        for span in [*sorted(set(found)), None]:
            if chain and (span is None or span[0] >= reach):
                begin, end, edits, match = min(chain, key=lambda s: (s[2], s[0], s[1]))
                doc = text.doc(begin)
                first = int(text.first[doc])
                yield Match(doc, k, text.word(begin) - first, text.word(end - 1) - first, edits, match)
                chain, reach = [], -1
            if span is not None:
                chain.append(span)
                reach = max(reach, span[1])


def _labels(labels: set[str]) -> str:
    return ",".join(sorted(labels))


def license_scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_fuzzy.

    ``n_base`` counts the places where a phrase's words follow one another, ``first_word`` and ``last_word`` are the smallest
    and largest of their first words (from 0, NULL without any). ``labels`` has those of matched notices too; ``n_fuzzy``
    counts matches with at least one edit. The score is the largest share of a notice's characters that did not have to be
    edited, 1 with an exact phrase, 0 without any. NULL and empty texts have no words. Repeated rows are judged each, a NULL
    id stays NULL, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in slices(batches):
            text, n = Normalised(batch["text"]), batch.num_rows
            count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            score, fuzzy = np.zeros(n), np.zeros(n, np.int64)
            base: dict[int, set[str]] = {}
            more: dict[int, set[str]] = {}
            for k, doc, word in scanner.base(text):
                count[doc] += 1
                first[doc], last[doc], score[doc] = min(first[doc], word), max(last[doc], word), 1.0
                base.setdefault(doc, set()).add(phrases[k][1])
            for match in scanner.matches(text):
                size = len(notices[match.notice].text)
                score[match.doc] = max(score[match.doc], (size - match.edits) / size)
                fuzzy[match.doc] += match.edits > 0
                more.setdefault(match.doc, set()).add(notices[match.notice].label)
            none = count == 0
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(np.diff(text.first), pa.int64()), pa.array(count),
                pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                pa.array([_labels(base.get(d, set())) for d in range(n)], pa.string()),
                pa.array([_labels(base.get(d, set()) | more.get(d, set())) for d in range(n)], pa.string()),
                pa.array(score), pa.array(fuzzy),
            ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_fuzzy"])

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, n_fuzzy long")


def license_spans(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """A row for each matched notice: doc_id, label, notice, first_word, last_word, edits, found (the words as they stand)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner((), notices)
        for batch in slices(batches):
            matches = list(scanner.matches(Normalised(batch["text"])))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(pa.array([m.doc for m in matches], pa.int64())),
                pa.array([notices[m.notice].label for m in matches], pa.string()),
                pa.array([notices[m.notice].text for m in matches], pa.string()),
                *(pa.array([m[k] for m in matches], pa.int64()) for k in (2, 3, 4)),
                pa.array([m.found for m in matches], pa.string()),
            ], ["doc_id", "label", "notice", "first_word", "last_word", "edits", "found"])

    return _texts(docs).mapInArrow(
        run, "doc_id long, label string, notice string, first_word long, last_word long, edits long, found string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
