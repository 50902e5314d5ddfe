"""Words as numpy arrays, and exchanges of packed arrays between Spark tasks.

A row per word would cost more than the work on the word, so operators on word shingles handle a slice of documents
as flat arrays and send what belongs to one partition as one binary value. Spark still partitions, shuffles, retries
and spills; a task holds one slice or one partition, never a whole table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

SLICE_BYTES = 4 << 20
PACKED = "part int, kind int, data binary"
NO_ID = np.iinfo(np.int64).max
"""Stands for a missing document id: after every other id."""

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = 0xC2B2AE3D27D4EB4F
_tables: list[np.ndarray] = []


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Mapper) -> Mapper:
    """``run``, after which a worker gives unused memory back to the system.

    Workers live on from stage to stage, and several of them idle beside the ones at work; what the allocators keep
    for later adds up to more than what a task needs.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 20)
        _tables[:] = [
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
            for base in (_BASE, _BASE_INVERSE)
        ]
    return _tables


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts, as positions in their joined bytes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if body is not None else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        self.inside = ~_SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[self.bounds] = True
        self.starts = np.flatnonzero(self.inside & (first[:-1] | np.concatenate([[True], ~self.inside[:-1]])))
        self.ends = np.flatnonzero(self.inside & (first[1:] | np.concatenate([~self.inside[1:], [True]]))) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        """Index of each text's first word; the last entry is the number of words."""
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.starts)) - self.first[self.doc]

    def hashes(self, block: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash per word; long inputs are hashed block by block."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + block, "right")))
            span = int(self.ends[to - 1] - base)
            power, inverse = _powers(span + 1)
            total = np.zeros(span + 1, np.uint64)
            np.cumsum((self.data[base:base + span].astype(np.uint64) + _U(1)) * power[:span], out=total[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = to
        return out

    def fits(self, k: int) -> np.ndarray:
        """Whether ``k`` words of the same text begin at each word."""
        return self.place + k <= self.counts[self.doc]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words that begin at each word; the last ``k`` - 1 are meaningless."""
    wide, size = {1: words}, 1
    while size * 2 <= k:
        wide[size * 2] = _joined(wide[size], wide[size], size)
        size *= 2
    out, done = wide[size], size
    for size in sorted(wide, reverse=True):
        if done + size <= k:
            out = _joined(out, wide[size], done, size)
            done += size
    return mix(out + _U(k))


def _joined(left: np.ndarray, right: np.ndarray, shift: int, width: int | None = None) -> np.ndarray:
    """Hash of ``shift`` words (left) followed by ``width`` words (right, as hashed from its own beginning)."""
    moved = np.zeros_like(right)
    moved[: max(len(right) - shift, 0)] = right[shift:]
    return left * _U(pow(_STEP, width or shift, 1 << 64)) + moved


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of any lengths as bytes. Each is stored byte plane by byte plane, which compresses well in the shuffle."""
    head = [str(len(columns))]
    body = []
    for column in columns:
        column = np.ascontiguousarray(column)
        head.append(f"{column.dtype.str}:{len(column)}")
        body.append(column.view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes())
    return (",".join(head) + "\n").encode() + b"".join(body)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`."""
    at = data.index(b"\n")
    columns = []
    kinds = data[:at].decode().split(",")[1:]
    at += 1
    for kind in kinds:
        name, n = kind.split(":")
        dtype, n = np.dtype(name), int(n)
        plane = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        columns.append(np.ascontiguousarray(plane.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return columns


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings rows of a part together, and where each part begins in it."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def rows(parts: list[int], kinds: list[int], data: list[bytes]) -> pa.RecordBatch:
    """A batch of the PACKED schema."""
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"]
    )


def scattered(part: np.ndarray, parts: int, kind: int, *columns: np.ndarray, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows of the PACKED schema: equally long columns, one packed value for each part that has rows."""
    order, at = by_part(part, parts)
    full = np.flatnonzero(np.diff(at))
    moved = [column[order] for column in columns]
    for i in range(0, len(full), most):
        some = full[i:i + most]
        yield rows(some.tolist(), [kind] * len(some), [pack(*(c[at[p]:at[p + 1]] for c in moved)) for p in some])


def part_count(spark: SparkSession) -> int:
    """Partitions of a packed exchange: as many as the session gives a shuffle, so they grow with the setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exchanged(df: DataFrame, parts: int) -> DataFrame:
    """Rows of the PACKED schema, those of one part in one partition."""
    return df.repartitionById(parts, F.col("part"))


def gathered(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[list[np.ndarray]]:
    """The unpacked values of one kind, as they come in."""
    for batch in batches:
        for k, data in zip(batch["kind"].to_pylist(), batch["data"], strict=True):
            if k == kind:
                yield unpack(data.as_py())


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """The id column as int64, NO_ID where it is null."""
    return batch[name].cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
