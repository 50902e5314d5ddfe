"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, each half has a codebook, and the product of the codebooks is a grid of cells. Every
vector lies in the cell of its nearest codewords. A query visits cells in the order of the summed distances of its halves
to the cells' codewords, and stops at a margin beyond its own cell. The margin is measured when the codebooks are fitted:
it reaches the target recall on links exactly at the threshold, which are the hardest; closer vectors are found more
surely. What a query meets is verified by the cosine in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.components import components
from newsloom.session import stage

THRESHOLD = 0.9
FEWEST, MOST = 64, 1024
"""Codewords of a half. Their number grows with the square root of the number of vectors, so cells keep their size longer."""
SAMPLE = 8192
"""Bound of the sample that the codebooks are fitted on: the vectors with the smallest hashes of their content."""
RECALL = 0.98
"""Share of the links exactly at the threshold that the traversal has to meet."""
BLOCK = 4096
_UNIT = "vec_id long, digest binary, vector binary"


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles; None for what links with nothing."""
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    flat = np.where(values.is_null().to_numpy(zero_copy_only=False), np.nan, flat) if values.null_count else flat
    out: list[np.ndarray | None] = []
    for present, a, b in zip(column.is_valid().to_pylist(), offsets[:-1], offsets[1:], strict=True):
        v = flat[a:b] if present else flat[:0]
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(v).max() if len(v) else 0.0
            good = bool(np.isfinite(top)) and top > 0 and not np.isnan(v).any()
        out.append(v / top if good else None)
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for v in _rows(batch["embedding"]):
            body = None if v is None else (v / np.linalg.norm(v)).tobytes()
            found.append((None if body is None else hashlib.blake2b(body, digest_size=16).digest(), body))
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], pa.array([d for d, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())],
            ["vec_id", "digest", "vector"])


def _codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from spread-out first codewords; fewer than ``k`` when there are fewer distinct points."""
    centres = [x[0]]
    least = ((x - x[0]) ** 2).sum(1)
    while len(centres) < k and least.max() > 1e-12:
        centres.append(x[int(least.argmax())])
        least = np.minimum(least, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        near = _squared(x, c).argmin(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


class Grid:
    """The two codebooks, and how far beyond its own cell a query has to look."""

    def __init__(self, sample: np.ndarray, codewords: int, threshold: float, recall: float):
        half = sample.shape[1] // 2
        self.books = [
            _codebook(sample[:, s], codewords) if s.stop > s.start else np.zeros((1, 0))
            for s in (slice(0, half), slice(half, sample.shape[1]))]
        # A neighbour in a random direction, at the threshold, of each vector of the sample.
        aside = np.random.default_rng(0).normal(size=sample.shape)
        aside -= (aside * sample).sum(1)[:, None] * sample
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
        one, two = self.halves(sample)
        i, j = (d.argmin(1) for d in self.halves(threshold * sample + np.sqrt(1 - threshold**2) * aside))
        row = np.arange(len(sample))
        self.margin = float(np.quantile(one[row, i] + two[row, j] - one.min(1) - two.min(1), recall)) + 1e-9

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        cut = self.books[0].shape[1]
        return [_squared(x[:, :cut], self.books[0]), _squared(x[:, cut:], self.books[1])]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.halves(x)
        return one.argmin(1), two.argmin(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells that queries visit: query, first codeword, and the second codewords as a row of booleans."""
        one, two = self.halves(x)
        rest = (one.min(1) + two.min(1) + self.margin)[:, None] - one
        query, first = np.nonzero(rest >= two.min(1)[:, None])
        return query, first, two[query] <= rest[query, first][:, None]

    def sees(self, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each query (a row) visits each of the cells (a column)."""
        one, two = self.halves(x)
        rest = (one.min(1) + two.min(1) + self.margin)[:, None] - one
        return (rest[:, first] >= two.min(1)[:, None]) & (two[:, second] <= rest[:, first])


def _matrix(column: pa.Array) -> np.ndarray:
    found = column.to_pylist()
    return np.frombuffer(b"".join(found)).reshape(len(found), -1)


def _load(grid: Grid):
    """Members and queries of each first codeword, a row per batch and codeword."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(grid.books[0])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                x = _matrix(whole["vector"].slice(at, 1024))
                counts = [np.bincount(f, minlength=k) for f in (grid.home(x)[0], grid.visits(x)[1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *map(pa.array, counts)], ["first", "members", "queries"])

    return run


def _spread(value: np.ndarray, over: np.ndarray) -> np.ndarray:
    return ((value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % over


def _dealt(grid: Grid, member_blocks: np.ndarray, query_blocks: np.ndarray):
    """Members under their first codeword and queries under every first codeword they visit, cut into blocks.

    ``cells`` has the second codewords: a member's own, a query's visited ones as bits.
    """

    def copies(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who = np.repeat(np.arange(len(count)), count)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, ids = _matrix(batch["vector"]), batch["id"].to_numpy()
                home, second = grid.home(x)
                who, visited, inside = grid.visits(x)
                full = member_blocks[visited] > 0
                who, visited, bits = who[full], visited[full], np.packbits(inside[full], axis=1)
                own = [int(c).to_bytes(4, "little") for c in second]
                for query in (False, True):
                    rows, first = (who, visited) if query else (np.arange(len(x)), home)
                    mine, others = (query_blocks, member_blocks) if query else (member_blocks, query_blocks)
                    copy, other = copies(others[first])
                    block = _spread(ids[rows], mine[first])[copy]
                    pair = (other, block) if query else (block, other)
                    for i in range(0, len(copy), 4096):
                        c = copy[i:i + 4096]
                        take = pa.array(rows[c])
                        cells = [bits[k].tobytes() for k in c] if query else [own[k] for k in rows[c]]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(first[c], pa.int64()), pa.array(pair[0][i:i + 4096], pa.int64()), pa.array(pair[1][i:i + 4096], pa.int64()),
                            pa.array(np.full(len(c), query)), pa.array(cells, pa.binary()),
                            batch["id"].take(take), batch["size"].take(take), batch["vector"].take(take),
                        ], _DEALT_NAMES)

    return run


_DEALT = "first long, member_block long, query_block long, query boolean, cells binary, id long, size long, vector binary"
_DEALT_NAMES = [c.split()[0] for c in _DEALT.split(", ")]


def _verifier(grid: Grid, threshold: float):
    def verified(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The number of links of queries and members of this block, and as many links as connect what is linked.

        A link counts for both of its vectors. Where each one's traversal comes by the other's cell, each counts it as a
        query; where the member's does not, it is counted here for the member too.
        """
        table = table.combine_chunks()
        query = table["query"].to_numpy()
        ids, size = table["id"].to_numpy(), table["size"].to_numpy()
        x = _matrix(table["vector"].combine_chunks())
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        cells = table["cells"].to_pylist()
        cell = np.array([int.from_bytes(cells[i], "little") for i in m], np.int64)
        bits = np.frombuffer(b"".join(cells[i] for i in q), np.uint8).reshape(len(q), -1)
        total, back, root = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64), np.arange(len(m))
        home = grid.home(x[q])
        a, b = [], []
        for c in np.unique(cell):
            inside = np.flatnonzero(cell == c)
            member = m[inside]
            asking = np.flatnonzero(bits[:, c >> 3] & (128 >> (c & 7))) if len(q) else q
            for i in range(0, len(asking), 512):
                some = asking[i:i + 512]
                hit = (x[q[some]] @ x[member].T >= threshold) & (ids[q[some]][:, None] != ids[member])
                total[some] += hit @ size[member]
                there, here = np.flatnonzero(hit.any(0)), np.flatnonzero(hit.any(1))
                seen = grid.sees(x[member[there]], home[0][some[here]], home[1][some[here]])
                back[inside[there]] += (hit[np.ix_(here, there)].T & ~seen) @ size[q[some[here]]]
                for row in here:
                    met = np.unique(root[inside[hit[row]]])
                    if len(met) > 1:
                        root[np.isin(root, met)] = met[0]
                    a += [int(ids[q[some[row]]])] * len(met)
                    b += ids[m[met]].tolist()
        some, more = np.flatnonzero(total), np.flatnonzero(back)
        counted = [*ids[q[some]].tolist(), *ids[m[more]].tolist()]
        return pa.table({
            "a": pa.array(counted + a, pa.int64()), "b": pa.array([None] * len(counted) + b, pa.int64()),
            "links": pa.array([*total[some].tolist(), *back[more].tolist(), *[0] * len(a)], pa.int64())})

    return verified


def codewords_for(n: int) -> int:
    """A power of two near a quarter of the square root of ``n``, within FEWEST and MOST."""
    return min(max(1 << max(round(math.log2(max(n, 1)) / 2) - 2, 0), FEWEST), MOST)


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, codewords: int | None = None, sample: int = SAMPLE,
    recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """Per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors of one width are linked when their cosine is at least ``threshold``. NULL, empty and zero vectors, vectors
    with NULL or non-finite components and rows without an id link with nothing and are kept. Each width has a grid of its
    own. Equal directions are one vector of that multiplicity, so copies are counted and not compared. Of
    several vectors of one id the one with the smallest digest counts. Repeated rows each come back.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    units = stage(rows.mapInArrow(_units, _UNIT), "units")
    valid = units.filter("vector IS NOT NULL AND vec_id IS NOT NULL")
    chosen = valid.groupBy("vec_id").agg(F.min(F.struct("digest", "vector")).alias("v"))
    groups = stage(chosen.groupBy("v.digest").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("v.vector").alias("vector")), "points")
    # A row per width of vectors.
    widths = {r["width"] // 8: r["n"] for r in groups.groupBy(F.octet_length("vector").alias("width")).agg(F.count("*").alias("n")).collect()}
    named = None
    for width in sorted(widths):
        points = groups.filter(F.octet_length("vector") == 8 * width)
        found = _linked(points, codewords or codewords_for(widths[width]), threshold, sample, recall, block)
        named = found if named is None else named.unionByName(found)
    if named is None:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = chosen.select("vec_id", "v.digest").join(named, "digest").select("vec_id", "digest", "n_links", "component_id")
    return units.join(known, ["vec_id", "digest"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))


def _linked(points: DataFrame, codewords: int, threshold: float, sample: int, recall: float, block: int) -> DataFrame:
    """(digest, n_links, component_id) for the points (digest, id, size, vector) of one width."""
    some = points.orderBy("digest").limit(sample).select("vector").collect()
    grid = Grid(np.array([np.frombuffer(r["vector"]) for r in some]), codewords, threshold, recall)
    # A row per first codeword, of which there are ``codewords``.
    load = points.select("vector").mapInArrow(_load(grid), "first long, members long, queries long").groupBy("first").agg(
        F.sum("members").alias("members"), F.sum("queries").alias("queries")).collect()
    blocks = np.zeros((2, len(grid.books[0])), np.int64)
    for r in load:
        blocks[:, r["first"]] = -(-r["members"] // block), -(-r["queries"] // block)
    found = stage(points.mapInArrow(_dealt(grid, *blocks), _DEALT).groupBy("first", "member_block", "query_block").applyInArrow(
        _verifier(grid, threshold), "a long, b long, links long"), "vector-links")
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("id"), "component")
    return points.select("digest", "id", "size").join(links, "id", "left").join(joined, "id", "left").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
