"""Exact similarity join of shingle sets with block skipping.

Sets are ordered by rarity of their shingles, so two similar sets share one among the first few (prefix filter), and each
shingle's index list is walked only where sizes and positions still allow the threshold. Sets are cut into blocks: those
that follow one leader, the most central set of their lists, and have about one size, at most BLOCK of them. A list compares
each set with what it knows of a whole block (smallest size, largest partner still allowed) and skips the block or sends the
set there. Every pair of blocks that is left is verified by itself, all sets that were sent against all others, so no
task holds more than two blocks, and copies of sets grow with the number of blocks met, not with the sets in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.components import components
from newsloom.llm.packed import (
    PACKED, Words, exchanged, gathered, grams, ids_of, lean, mix, pack, part_count, rows, scattered, slices,
)
from newsloom.session import stage

SHINGLE = 5
SLICE = 1 << 20
"""Bytes of text whose shingles a task holds at once."""
BLOCK = 1024
_POSTINGS, _DOCS, _COUNTS = 0, 1, 2
_SETS = "id long, n int, size long, shingles binary"
_U = np.uint64


def linked(shared, n, m):
    """Similarity of at least 0.75: 100 * shared >= 75 * (n + m - shared)."""
    return 7 * shared >= 3 * (n + m)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Two linked sets share a shingle among the first so many of each, in any common order."""
    return n - (3 * n + 3) // 4 + 1


def _least_shared(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, (n - 1) // 20)


class Sets:
    """The distinct shingles of each text, sorted, as one flat array."""

    def __init__(self, texts: pa.Array, size: int = SHINGLE):
        words = Words(texts, lower=True)
        hashes = words.hashes()
        at = np.flatnonzero(words.fits(size))
        shingle, doc = grams(hashes, size)[at], words.doc[at]
        for short in range(1, size):
            some = np.flatnonzero(words.counts == short)
            if len(some):
                shingle = np.concatenate([shingle, grams(hashes, short)[words.first[some]]])
                doc = np.concatenate([doc, some])
        order = np.lexsort((shingle, doc))
        shingle, doc = shingle[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
        self.shingles, self.doc = shingle[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(words.counts) + 1))
        self.n = np.diff(self.first)
        # Two independent sums name the set, whatever order it came in.
        sums = np.zeros((2, len(self.shingles) + 1), _U)
        np.cumsum(mix(self.shingles ^ _U(0x5851F42D4C957F2D)), out=sums[0, 1:])
        np.cumsum(mix(self.shingles + _U(0x14057B7EF767814F)), out=sums[1, 1:])
        total = sums[:, self.first[1:]] - sums[:, self.first[:-1]]
        self.key = mix(total[0] + self.n.astype(_U)).view(np.int64)
        self.key2 = mix(total[1]).view(np.int64)


def _named(chosen: np.ndarray, doc: np.ndarray, part: np.ndarray, parts: int, kind: int, names: list[np.ndarray],
           *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings dealt out by part; each packed value names the sets that occur in it once."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    moved, doc = [c[order] for c in columns], doc[order]
    out: tuple[list, list, list] = ([], [], [])
    for p in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[p], bounds[p + 1]
        known, local = np.unique(doc[a:b], return_inverse=True)
        out[0].append(int(p))
        out[1].append(kind)
        out[2].append(pack(local.astype(np.uint16 if len(known) < 1 << 16 else np.uint32), *(c[known] for c in names), *(c[a:b] for c in moved)))
        if len(out[0]) >= 128:
            yield rows(*out)
            out = ([], [], [])
    if out[0]:
        yield rows(*out)


def _scan(parts: int):
    """Every document's size and set keys, and the postings that can show whether its set may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            sets = Sets(batch["text"])
            absent = batch["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            home = int(mix(np.bitwise_xor.reduce(sets.key, keepdims=True).view(_U))[0] % _U(parts))  # any part: all alike
            yield rows([home], [_DOCS], [pack(ids_of(batch), absent, sets.n.astype(np.int64), sets.key, sets.key2)])
            length = prefix_length(sets.n) - 1 + _least_shared(sets.n)
            _, once = np.unique(sets.key, return_index=True)
            first = np.zeros(len(sets.n), bool)
            first[once] = True
            nth = np.arange(len(sets.doc)) - sets.first[sets.doc]
            use = np.flatnonzero((nth < length[sets.doc]) & first[sets.doc])
            if len(use):
                h = sets.shingles[use]
                yield from _named(use, sets.doc[use], ((h & _U(0xFFFFFFFF)) % _U(parts)).astype(np.int64), parts, _POSTINGS,
                                  [sets.key], (h >> _U(32)).astype(np.uint32))

    return run


def _partnered(parts: int):
    """How many of a set's early shingles occur in another set too. Documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from newsloom.llm.packed import unpack

        found = []
        for batch in batches:
            for part, kind, data in zip(batch["part"].to_pylist(), batch["kind"].to_pylist(), batch["data"], strict=True):
                if kind == _DOCS:
                    yield rows([part], [kind], [data.as_py()])
                else:
                    local, key, h = unpack(data.as_py())
                    found.append((key[local], h))
        if not found:
            return
        key, h = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.lexsort((key, h))
        key, h = key[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        key, h = key[new], h[new]
        same = h[1:] == h[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        sets, counts = np.unique(key[shared], return_counts=True)
        if len(sets):
            yield from scattered((sets.view(_U) % _U(parts)).astype(np.int64), parts, _COUNTS, sets, counts.astype(np.uint32))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = list(gathered(batches, _COUNTS))
    if found:
        key, which = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        total = np.bincount(which, np.concatenate([f[1] for f in found]), len(key)).astype(np.int64)
        for i in range(0, len(key), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(key[i:i + 65_536]), pa.array(total[i:i + 65_536])], ["key", "shared"])


def _unpacked_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, absent, n, key, key2 in gathered(batches, _DOCS):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=absent.astype(bool)), pa.array(n), pa.array(key), pa.array(key2)], ["doc_id", "n", "key", "key2"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, size=SLICE):
        sets = Sets(batch["text"])
        good = np.flatnonzero((sets.key == batch["key"].to_numpy()) & (sets.key2 == batch["key2"].to_numpy()))
        if len(good):
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(pa.array(good)), pa.array(sets.n[good].astype(np.int32)), batch["size"].take(pa.array(good)),
                pa.array([sets.shingles[sets.first[i]:sets.first[i + 1]].tobytes() for i in good], pa.binary()),
            ], ["id", "n", "size", "shingles"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes, all shingles, and the row each belongs to."""
    n = batch["n"].to_numpy().astype(np.int64)
    return (batch["id"].to_numpy(), n, np.frombuffer(b"".join(batch["shingles"].to_pylist()), _U), np.repeat(np.arange(len(n)), n))


def _posted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles"):
            ids, _, h, doc = _flat(batch)
            yield from _named(doc, doc, (h % _U(parts)).astype(np.int64), parts, _POSTINGS, [ids], h)

    return run


def _frequencies(parts: int):
    """Shingles that at least two sets have, with their number of sets, sent back to the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(ids[local], h) for local, ids, h in gathered(batches, _POSTINGS)]
        if not found:
            return
        ids, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, h))
        ids, h = ids[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
        ids, h = ids[new], h[new]
        _, which, count = np.unique(h, return_inverse=True, return_counts=True)
        df = count[which]
        many = df >= 2
        ids, h, df = ids[many], h[many], df[many]
        if len(ids):
            known, doc = np.unique(ids, return_inverse=True)
            part = (mix(known.astype(_U)) % _U(parts)).astype(np.int64)
            yield from _named(doc, doc, part[doc], parts, _POSTINGS, [known], h, df.astype(np.uint32))

    return run


_PREFIXES = "part int, h long, id long, n int, place int, central float"


def _prefixes(parts: int):
    """For each set its prefix in the order (number of sets, shingle), without shingles of one set only.

    Reads packed frequencies and, as kind _DOCS, the sets' sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from newsloom.llm.packed import unpack

        posts, sizes = [], []
        for batch in batches:
            for kind, data in zip(batch["kind"].to_pylist(), batch["data"], strict=True):
                if kind == _DOCS:
                    sizes.append(unpack(data.as_py()))
                else:
                    local, ids, h, df = unpack(data.as_py())
                    posts.append((ids[local], h, df))
        if not posts:
            return
        known, at = np.unique(np.concatenate([s[0] for s in sizes]), return_index=True)
        n = np.concatenate([s[1] for s in sizes])[at].astype(np.int64)
        ids, h, df = (np.concatenate(x) for x in zip(*posts, strict=True))
        order = np.lexsort((h, df, ids))
        h, df, doc = h[order], df[order], np.searchsorted(known, ids[order])
        count = np.bincount(doc, minlength=len(known))
        nth = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        place = (n - count)[doc] + nth
        central = (np.bincount(doc, df, len(known)) / np.maximum(n, 1)).astype(np.float32)
        use = np.flatnonzero(place < prefix_length(n)[doc])
        for i in range(0, len(use), 65_536):
            u = use[i:i + 65_536]
            yield pa.RecordBatch.from_arrays([
                pa.array((h[u] % _U(parts)).astype(np.int32)), pa.array(h[u].view(np.int64)), pa.array(known[doc[u]]),
                pa.array(n[doc[u]].astype(np.int32)), pa.array(place[u].astype(np.int32)), pa.array(central[doc[u]]),
            ], ["part", "h", "id", "n", "place", "central"])

    return run


def _sized(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            yield from scattered((mix(ids.astype(_U)) % _U(parts)).astype(np.int64), parts, _DOCS, ids, batch["n"].to_numpy())

    return run


def _lists(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[dict[str, np.ndarray]]:
    """The postings of one partition as columns, sorted by shingle; ``first`` bounds the lists."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        table = pa.Table.from_batches(batches)
        c = {n: table[n].to_numpy() for n in ("h", *names)}
        order = np.lexsort(tuple(c[n] for n in reversed(("h", *names))))
        c = {n: x[order] for n, x in c.items()}
        c["first"] = np.concatenate([[0], np.flatnonzero(c["h"][1:] != c["h"][:-1]) + 1, [len(order)]])
        yield c


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each occurs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[at], b[at], np.diff(np.concatenate([at, [len(a)]]))


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set the leaders of its lists, itself included, with how many of this partition's lists say so."""
    for c in _lists(batches, "id", "n", "central"):
        first = c["first"]
        group = np.repeat(np.arange(len(first) - 1), np.diff(first))
        best = np.lexsort((c["id"], -c["central"], group))[first[:-1]][group]
        x, leader = c["id"], c["id"][best]
        low, high = np.minimum(c["n"], c["n"][best]), np.maximum(c["n"], c["n"][best])
        use = 4 * low >= 3 * high
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(x[use], leader[use])], ["id", "leader", "lists"])


_MET = "low long, high long, id long, left boolean"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set the blocks that may hold a partner of it, as far as one list's sizes and positions tell.

    From its place on, a set of size n can still share n - place shingles, which allows partners up to the size
    (7 * (n - place) - 3 * n) / 3. Two sets are compared only if each allows the other's size.
    """
    for c in _lists(batches, "block", "id", "n", "place"):
        block, ids, n, first = c["block"], c["id"], c["n"].astype(np.int64), c["first"]
        most = (7 * (n - c["place"]) - 3 * n) // 3
        new = np.zeros(len(n), bool)
        new[first[:-1]] = True
        new[1:] |= block[1:] != block[:-1]
        at = np.flatnonzero(new)
        least, widest, held = np.minimum.reduceat(n, at), np.maximum.reduceat(most, at), np.diff(np.concatenate([at, [len(n)]]))
        mine = np.cumsum(new) - 1
        bounds = np.searchsorted(at, first)
        which = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin, count = bounds[:-1][which], np.diff(bounds)[which]
        total = np.concatenate([[0], np.cumsum(count)])
        found, size, i = [], 0, 0
        while i < len(n):
            to = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 20), "right")) - 1)
            e = np.repeat(np.arange(i, to), count[i:to])
            other = begin[e] + np.arange(total[i], total[to]) - total[e]
            good = (least[other] <= most[e]) & (widest[other] >= n[e]) & ((other != mine[e]) | (held[other] > 1))
            e, other = e[good], other[good]
            found.append((ids[e], block[e], block[at[other]]))
            size += len(e)
            i = to
            if size > 1 << 20 or i == len(n):
                x, own, far = (np.concatenate(f) for f in zip(*found, strict=True))
                order = np.lexsort((far, x))
                x, own, far = x[order], own[order], far[order]
                keep = np.ones(len(x), bool)
                keep[1:] = (x[1:] != x[:-1]) | (far[1:] != far[:-1])
                found = [(x[keep], own[keep], far[keep])]
                size = 0
        x, own, far = found[0]
        for i in range(0, len(x), 65_536):
            u, v = own[i:i + 65_536], far[i:i + 65_536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(x[i:i + 65_536]), pa.array(u <= v)], ["low", "high", "id", "left"])


def _shared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``."""
    width = len(b)
    owner, shingle = [], []
    for some in (a, b):
        owner.append(np.repeat(np.arange(len(some)), [len(x) // 8 for x in some]))
        shingle.append(np.frombuffer(b"".join(some), _U))
    both = [np.unique(x, return_inverse=True, return_counts=True) for x in shingle]
    _, *at = np.intersect1d(both[0][0], both[1][0], assume_unique=True, return_indices=True)
    column, many = [], []
    for side in (0, 1):
        known, inverse, count = both[side]
        name = np.full(len(known), -1)
        name[at[side]] = np.arange(len(at[side]))
        column.append(name[inverse])
        many.append(count[at[side]].astype(np.int64))
    out = np.zeros((len(a), width), np.float32)
    # Shingles of many sets on both sides are multiplied, others listed pair by pair.
    dense = many[0] * many[1] * 512 > len(a) * width
    for i in range(0, int(dense.sum()), 1024):
        chosen = np.flatnonzero(dense)[i:i + 1024]
        place = np.full(len(dense) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        tables = []
        for side, height in ((0, len(a)), (1, width)):
            here = np.flatnonzero(place[column[side]] >= 0)
            table = np.zeros((height, len(chosen)), np.float32)
            table[owner[side][here], place[column[side][here]]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    sparse = np.append(~dense, False)
    mine, other = (np.flatnonzero(sparse[column[side]]) for side in (0, 1))
    other = other[np.argsort(column[1][other], kind="stable")]
    low = np.searchsorted(column[1][other], column[0][mine])
    count = many[1][column[0][mine]]
    total = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(mine):
        to = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 20), "right")) - 1)
        near = np.repeat(low[i:to] - (total[i:to] - total[i]), count[i:to]) + np.arange(total[to] - total[i])
        pair = np.repeat(owner[0][mine[i:to]], count[i:to]) * width + owner[1][other[near]]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape)
        i = to
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one (low, high), from rows sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        low, high = batch["low"].to_numpy(), batch["high"].to_numpy()
        cut = [0, *(np.flatnonzero((low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1).tolist(), batch.num_rows]
        if rest and (rest[0]["low"][0].as_py(), rest[0]["high"][0].as_py()) != (int(low[0]), int(high[0])):
            yield pa.Table.from_batches(rest)
            rest = []
        for i, to in zip(cut[:-1], cut[1:], strict=True):
            if i:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(i, to - i))
    if rest:
        yield pa.Table.from_batches(rest)


_LINKS = "a long, b long, links long"


def _verifier(every: bool):
    """Links between the sets of two blocks: with ``every`` all of them (a < b), else how many documents each set is
    linked with (b is NULL) and as many links as connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "links"])
            for c in out:
                c.clear()
            return batch

        for table in _groups(batches):
            ids, left, size = (table[c].to_numpy() for c in ("id", "left", "size"))
            sets = table["shingles"].to_pylist()
            one = table["low"][0] == table["high"][0]
            once = np.array(list({(i, s): k for k, (i, s) in enumerate(zip(ids.tolist(), sets, strict=True))}.values()))  # repeated rows
            x, y = (once, once) if one else (once[left[once]], once[~left[once]])
            if not len(x) or not len(y) or len(once) < 2:
                continue
            n = np.array([len(s) // 8 for s in sets], np.int64)
            hit = linked(_shared([sets[i] for i in x], [sets[i] for i in y]), n[x][:, None], n[y]) & (ids[x][:, None] != ids[y])
            if every:
                for row in np.flatnonzero(hit.any(1)):
                    mine, other = ids[x[row]], ids[y[hit[row] & ((ids[y] > ids[x[row]]) | (not one))]]
                    out[0] += np.minimum(mine, other).tolist()
                    out[1] += np.maximum(mine, other).tolist()
                    out[2] += [1] * len(other)
                    if len(out[0]) >= 65_536:
                        yield flushed()
                continue
            root = np.arange(len(y))
            for row in np.flatnonzero(hit.any(1)):
                met = np.unique(root[hit[row]])
                if len(met) > 1:
                    root[np.isin(root, met)] = met[0]
                out[0] += [int(ids[x[row]])] * len(met)
                out[1] += ids[y[met]].tolist()
                out[2] += [0] * len(met)
            for side, links in ((x, hit @ size[y]), (y, [] if one else size[x] @ hit)):
                some = np.flatnonzero(links)
                out[0] += ids[side[some]].tolist()
                out[1] += [None] * len(some)
                out[2] += np.asarray(links)[some].tolist()
            if len(out[0]) >= 65_536:
                yield flushed()
        yield flushed()

    return run


def _scanned(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sizes and set keys; distinct sets with their smallest id and number of ids; sets that may be linked."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = stage(exchanged(docs.mapInArrow(lean(_scan(parts)), PACKED), parts).mapInArrow(lean(_partnered(parts)), PACKED), "jaccard-scan")
    table = stage(scan.filter(F.col("kind") == _DOCS).mapInArrow(lean(_unpacked_docs), "doc_id long, n long, key long, key2 long"), "jaccard-docs")
    counts = exchanged(scan.filter(F.col("kind") == _COUNTS), parts).mapInArrow(lean(_summed), "key long, shared long")
    groups = table.filter("n > 0").groupBy("key", "key2").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.count_distinct("doc_id").alias("size"))
    needed = F.greatest(F.lit(1), F.floor((F.col("n") - 1) / 20))
    hopeful = groups.filter("id IS NOT NULL").join(counts, "key").filter(F.col("shared") >= needed).select(
        F.col("id").alias("doc_id"), "key", "key2", "size")
    sets = stage(docs.join(hopeful, "doc_id").select(
        "doc_id", "key", "key2", "size", "text").mapInArrow(lean(_whole_sets), _SETS), "jaccard-sets")
    return table, groups, sets


def similar_documents(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, n_links, component_id (smallest doc_id reachable by links).

    A set holds the distinct runs of five lower-cased (A-Z) words; shorter texts are one shingle; texts without words
    and NULL have none and link with nothing. Equal sets are one set, named by its smallest id. A row without an id
    shares the component of an equal set that has one, and is NULL otherwise; it links with nothing else. Repeated
    rows each come back. ``n_links`` counts the other ids whose sets are linked, equal ones too; a row without an id has
    none and is counted nowhere. Other columns are ignored.
    """
    parts = part_count(docs.sparkSession)
    table, groups, sets = _scanned(docs, parts)
    links = _links(sets, parts)
    found = components(links.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("id"), "component")
    total = links.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    named = groups.select("key", "key2", "id", "size").join(found, "id", "left").join(total, "id", "left").select(
        "key", "key2", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    empty = table.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return table.filter("n > 0").join(named, ["key", "key2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("links")).alias("n_links"),
        F.col("component").alias("component_id")).unionByName(empty)


def similar_pairs(docs: DataFrame) -> DataFrame:
    """All links between distinct sets, (a, b) with a < b; a set is named by the smallest doc_id that has it."""
    parts = part_count(docs.sparkSession)
    return _links(_scanned(docs, parts)[2], parts, every=True).select("a", "b")


def _links(sets: DataFrame, parts: int, every: bool = False) -> DataFrame:
    """Verified links of (id, n, size, shingles), as :func:`_verifier` gives them."""
    back = exchanged(sets.mapInArrow(lean(_posted(parts)), PACKED), parts).mapInArrow(lean(_frequencies(parts)), PACKED)
    sizes = sets.select("id", "n").mapInArrow(lean(_sized(parts)), PACKED)
    prefixes = stage(exchanged(back.unionByName(sizes), parts).mapInArrow(lean(_prefixes(parts)), _PREFIXES), "jaccard-prefixes")
    votes = prefixes.repartitionById(parts, F.col("part")).mapInArrow(lean(_leaders), "id long, leader long, lists long")
    best = votes.groupBy("id", "leader").agg(F.sum("lists").alias("lists")).groupBy("id").agg(
        F.max_by("leader", F.struct("lists", -F.col("leader"))).alias("leader"))
    # Sizes of one block differ by at most 3 %, so what a list knows of the block is nearly true of each of its sets.
    led = stage(sets.select("id", "n").join(best, "id").select("id", "leader", F.floor(F.log("n") * 33).alias("step")), "jaccard-led")
    cut = led.groupBy("leader", "step").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = led.join(cut, ["leader", "step"]).select(
        "id", F.xxhash64("leader", "step", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block"))
    met = prefixes.select("part", "h", "id", "n", "place").join(placed, "id").repartitionById(parts, F.col("part")).mapInArrow(lean(_met), _MET).distinct()
    pairs = met.join(sets.select("id", "size", "shingles"), "id").repartition(parts, "low", "high").sortWithinPartitions("low", "high")
    return stage(pairs.mapInArrow(lean(_verifier(every)), _LINKS), "jaccard-links")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The row with the smallest id of each group of linked documents, all columns unchanged; rows without an id stay."""
    kept = similar_documents(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("doc_id").isNull()).select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
