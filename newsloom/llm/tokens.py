"""Tokens of whole texts, as the tokenizer library gives them.

The tokenizer never joins text across white space, so words are encoded once each and looked up by hash; huge documents
are encoded as overlapping chunks that are spliced where both chunkings provably agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.packed import Words, slices

CHUNK = 32_768
OVERLAP = 512
LIMIT = 2048
# A place before which no token can begin and cross it: after white space, or beside a digit (digits stand alone).
_STABLE = re.compile(r"(?<=[ \t\n\r\f\v0-9])|(?=[0-9])")
_MARK = "\x01"
_MOST_WORDS = 1_000_000
_loaded: dict[str, WordTokens] = {}


class WordTokens:
    """Token ids of words seen so far, as sorted hashes with positions in one flat array of ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """One per worker process, kept from task to task."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and flat ids of words; many are encoded together, with a mark between them."""
        ids: list[list[int] | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _MARK not in w]
        if len(self.mark) != 1:
            plain = []
        groups = [plain[i:i + 200] for i in range(0, len(plain), 200)]
        texts = [f" {_MARK} ".join(words[i] for i in g) for g in groups]
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            got = encoding.ids
            at = [-1, *[k for k, x in enumerate(got) if x == self.mark[0]], len(got)]
            if len(at) == len(group) + 1:
                for i, a, b in zip(group, at[:-1], at[1:], strict=True):
                    ids[i] = got[a + 1:b]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, encoding in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = encoding.ids
        sizes = np.array([len(x) for x in ids], np.int32)
        return sizes, np.fromiter((t for x in ids for t in x), np.uint32, int(sizes.sum()))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word: where its ids begin in ``flat``, and how many there are."""
        hashes = words.hashes()
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > _MOST_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            some = first[new]
            data = words.data.tobytes()
            texts = [data[s:e].decode() for s, e in zip(words.starts[some].tolist(), words.ends[some].tolist(), strict=True)]
            sizes, flat = self._encoded(texts)
            begin = len(self.flat) + np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)])
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.at = np.insert(self.at, at[new], begin)
            self.size = np.insert(self.size, at[new], sizes)
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.keys, unique)
        return self.at[at][which], self.size[at][which]

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts in order, and where each text's begin."""
        at, size = self.find(words)
        end = np.cumsum(size, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        flat = self.flat[np.repeat(at - (end - size), size) + np.arange(total)]
        return flat, np.concatenate([[0], end])[words.first]

    def long_count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a long text from overlapping chunks.

        Two neighbouring chunks are spliced at a place in their overlap that no token can cross, and where both have
        a token boundary. Where the overlap has no such place it is widened, at last to the whole rest of the text.
        """
        count, begin, cut, end = 0, 0, 0, min(chunk, len(text))
        starts = self._starts(text, 0, end)
        while end < len(text):
            wide = overlap
            while (place := self._common(text, starts, max(cut + 1, end - wide), end)) is None and end < len(text):
                wide *= 2
                end = min(end + wide, len(text))
                starts = self._starts(text, begin, end)
            if place is None:
                break
            count += int(((starts >= cut) & (starts < place)).sum())
            cut, wide, end = place, overlap, min(place + chunk, len(text))
            while True:
                begin = max(0, cut - wide)
                starts = self._starts(text, begin, end)
                if begin == 0 or cut in starts:
                    break
                wide *= 2
        return count + int((starts >= cut).sum())

    def _starts(self, text: str, begin: int, end: int) -> np.ndarray:
        encoding = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return np.array([o[0] for o in encoding.offsets], np.int64) + begin

    @staticmethod
    def _common(text: str, starts: np.ndarray, low: int, high: int) -> int | None:
        """The last stable place in [low, high) where the left chunk has a token start."""
        have = set(starts[starts >= low].tolist())
        stable = [low + m.start() for m in _STABLE.finditer(text[low - 1:high])]
        good = [p - 1 for p in stable if p - 1 in have and low <= p - 1 < high]
        return good[-1] if good else None


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Tokens as the library gives them for the whole text, without special tokens added; NULL and empty texts have none.
    Nothing is shuffled; a worker keeps at most a bounded number of words. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(tokenizer)
        for batch in slices(batches):
            texts = batch["text"]
            size = texts.fill_null("")
            huge = [i for i, n in enumerate(pc.utf8_length(size).to_pylist()) if n > chunk]
            if huge:
                mask = np.zeros(len(texts), bool)
                mask[huge] = True
                short = pc.if_else(pa.array(mask), "", size)
            else:
                short = size
            words = Words(short)
            _, found = tokens.find(words)
            counts = np.diff(np.concatenate([[0], np.cumsum(found, dtype=np.int64)])[words.first])
            for i in huge:
                counts[i] = tokens.long_count(texts[i].as_py(), chunk)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pc.binary_length(size).cast(pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
