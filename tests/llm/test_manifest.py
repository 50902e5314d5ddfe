"""The Merkle manifest, hard negatives and license scan against plain loops; the digest index, vectors, archives."""

import gzip
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import hard_negatives as hn, licenses, merkle
from newsloom.llm.backoff import _home
from newsloom.llm.exact_dedup import DigestIndex, exact_dedup, kept_documents
from newsloom.llm.multi_index import codewords_for, near_vectors
from newsloom.llm.substring import without_repeats
from newsloom.llm.warc import inflated
from tests.llm import brute

CLASHING = ("n", "word", "key", "place", "size", "path", "leaf", "digest", "uid", "part", "score", "rank", "asks", "labels", "spans")


def clashing(df):
    """Over several partitions, with columns whose names an operator might use itself."""
    return df.repartition(3).withColumns({n: F.lit("x") for n in CLASHING if n not in df.columns})


# ---- manifest --------------------------------------------------------------------------------------

DOCUMENT = "doc_id long, source string, lang string, n_chars int, text string"


def manifest(spark, rows):
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lower_ascii(text)).otherwise(text)
    found = merkle.merkle_manifest(clashing(spark.createDataFrame(rows, DOCUMENT)), tampered)
    return sorted([tuple(r) for r in found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


@pytest.fixture(scope="module")
def documents():
    """Ties on ids, copies of rows, ids at the ends of their range, missing ids, sources and texts."""
    r = random.Random(3)
    rows = [(r.randrange(-50, 400), r.choice([None, "", "a", "ab", "ä", "b"]), "en", 5, f"Text {i % 90}") for i in range(600)]
    rows += [(None, r.choice(["a", "b"]), "en", 5, f"T {i % 30}") for i in range(60)] + [(7, "a", None, None, None)] * 30
    rows += [(7, "a", "x", 1, f"u{i}") for i in range(40)] + [(None, "lone", None, None, "X" * 100_000)]
    rows += [(2**62 + 5, "a", "x", 1, "U"), (-2**63, "a", "x", 1, "U"), (2**63 - 1, "zz", None, 1, "U")]
    return rows


def test_manifest_equals_brute_force(spark, documents):
    found = manifest(spark, documents)
    assert found == brute.merkle(documents)
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_manifest_with_directories_of_directories(spark, documents, monkeypatch):
    monkeypatch.setattr(merkle, "DIRECTORY", 3)
    rows = documents[::3]
    assert manifest(spark, rows) == brute.merkle(rows)


def test_manifest_of_few_rows(spark):
    assert manifest(spark, []) == []
    for n in (1, 2, 16, 17):
        rows = [(i, "s", "en", 3, f"A{i}") for i in range(n)]
        assert manifest(spark, rows) == brute.merkle(rows)


def test_manifest_paths(spark, documents):
    """A path folds the leaf into the root, and every change of a field is noticed."""
    rows = documents[:120]
    found = merkle.merkle_manifest(spark.createDataFrame(rows, DOCUMENT)).collect()
    assert all(r["verified"] for r in found)
    for r in found[:10]:
        node = r["leaf"]
        for step in r["path"]:
            node = brute._sha(bytes(step["left"]).hex() + node + bytes(step["right"]).hex())
        assert node == r["root"] == r["folded_root"]
    other = [(*rows[0][:2], "xx", *rows[0][3:]), *rows[1:]]
    assert merkle.merkle_manifest(spark.createDataFrame(other, DOCUMENT)).first()["root"] != found[0]["root"]


# ---- hard negatives --------------------------------------------------------------------------------


def mined(spark, rows, kind="float"):
    df = clashing(spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>"))
    vec_id = F.col("vec_id")
    return sorted([tuple(r) for r in hn.hard_negatives(df, hn.relabelled(vec_id, F.col("label")), vec_id % 100 == 0).collect()], key=str)


def test_hard_negatives_equal_brute_force(spark):
    """One vector a third of the rows have, several widths, repeated ids, rows that take no part."""
    r = np.random.default_rng(3)
    vector = lambda w: [float(np.float32(x)) for x in r.normal(0, 0.2, w)]
    base = vector(6)
    rows = [(i, int(r.integers(0, 4)), base if i % 3 == 0 else vector(6)) for i in range(400)]
    rows += [(i, 1, vector(3)) for i in range(500, 560)] + [(600, 1, []), (601, 1, []), (602, 2, []), (603, None, vector(6)), (604, 1, None)]
    rows += [(700, 1, [None] * 6), (800, 1, [float("nan")] * 6), (900, 1, [float("inf")] * 6), (None, 1, vector(6)), (None, 2, vector(6))]
    rows += [(100, 1, vector(6)), (100, 2, base), (-100, 3, vector(6)), (1000, 2**31 - 1, base)]
    found = mined(spark, rows)
    assert found == brute.hard_negatives(rows) and len(found) > 100
    assert mined(spark, []) == []


@pytest.mark.parametrize("scale", [1e3, 1e6, 1e9, 1e13])
def test_hard_negatives_of_any_magnitude(spark, scale):
    r = np.random.default_rng(4)
    rows = [(i, int(r.integers(0, 3)), [float(x) for x in r.normal(0, scale, 4)]) for i in range(0, 300, 5)]
    assert mined(spark, rows, "double") == brute.hard_negatives(rows)


@pytest.mark.parametrize("scale", [1, 100, 10**6, 10**9, 10**30])
def test_packed_products(scale):
    r = np.random.default_rng(5)
    vectors, anchors = np.floor(r.normal(0, scale, (37, 9))), np.floor(r.normal(0, scale, (11, 9)))
    exact = [[min(max(sum(int(x) * int(y) for x, y in zip(a, v, strict=True)), 1 - 2**63), 2**63 - 1) for v in vectors] for a in anchors]
    assert hn.PackedVectors(vectors).products(anchors).tolist() == exact
    assert hn.PackedVectors(np.zeros((3, 0))).products(np.zeros((2, 0))).tolist() == [[0] * 3] * 2


def test_several_candidates_share_a_word():
    packed = hn.PackedVectors(np.floor(np.random.default_rng(6).normal(0, 32, (100, 64))))
    fields, words = packed._words(23)
    assert fields == 2 and words.shape == (64, 50)


# ---- licenses --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def notices():
    """Notices with edits of every kind, at the ends of texts, next to other scripts, torn words and repeats."""
    r = random.Random(9)
    letters = "abeglinstu é日"
    rows = [(0, None), (1, ""), (2, " \t\x00"), (3, "MIT License"), (4, "emit license"), (5, "remit license"), (6, "mitlicense mit-licence"),
            (7, "cc by cc by CC-BY-SA"), (8, "gnu general"), (9, "public license"), (10, "apáche licénse"), (11, "日mit license日 the"),
            (12, "mit license " * 300), (13, "x" * 5000 + " mit license"), (14, "gnugeneral public license"), (3, "apache license")]
    for i in range(250):
        text = r.choice(licenses.NOTICES).text
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(text))
            text = text[:at] + r.choice(["", r.choice(letters), r.choice(letters) + text[at]]) + text[at + 1:]
        rows.append((100 + i, r.choice(["", "the ", "a;", "日本 "]) + text.title() + r.choice(["", " x", ", and more", "日"]) * r.randint(0, 2)))
    return rows


def test_license_scan_equals_brute_force(spark, notices):
    found = licenses.license_scan(clashing(spark.createDataFrame(notices, "doc_id long, text string")))
    rows = sorted([tuple(r)[:8] for r in found.collect()], key=str)
    assert rows == brute.licenses(notices, licenses.PHRASES, licenses.NOTICES)
    assert found.filter("n_fuzzy > 0 and n_base = 0").count() > 50
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_license_spans(spark, notices):
    """A span's words are the text's, as many edits away as it says; spans of one notice don't overlap."""
    texts, ends = {}, {}
    for i, t in notices:
        texts.setdefault(i, []).append(brute.LICENSE_WORD.findall((t or "").translate(brute.LOWER)))
    found = licenses.license_spans(clashing(spark.createDataFrame(notices, "doc_id long, text string"))).collect()
    assert len(found) > 300
    for r in sorted(found, key=lambda r: (r["doc_id"], r["notice"], r["first_word"])):
        assert any(" ".join(w[r["first_word"]:r["last_word"] + 1]) == r["found"] for w in texts[r["doc_id"]])
        assert brute.edits(r["found"], r["notice"]) == r["edits"]
        assert ends.get((r["doc_id"], r["notice"]), -1) < r["first_word"]
        ends[r["doc_id"], r["notice"]] = r["last_word"]
    assert sum(r["doc_id"] == 12 for r in found) == 300


def test_bad_notices():
    with pytest.raises(ValueError):
        licenses.Scanner(notices=[licenses.Notice("MIT  license", "mit", 1)])
    with pytest.raises(ValueError):
        licenses.Scanner(notices=[licenses.Notice("mit", "mit", 3)])


# ---- digest index ----------------------------------------------------------------------------------


def test_index_with_more_buckets(spark):
    rows = [(i, f"t{i % 40}") for i in range(100)]
    index = DigestIndex(spark, buckets=2)
    exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), index)
    before = sorted(map(tuple, index.read().collect()))
    index.rebuild(8)
    assert DigestIndex(spark, index.table).buckets == 8 and sorted(map(tuple, index.read().collect())) == before
    later = exact_dedup(spark.createDataFrame([(500, "t3"), (501, "new")], "doc_id long, text string"), index)
    assert sorted((r["doc_id"], r["keep_id"]) for r in later.collect()) == [(500, 3), (501, 501)]
    index.drop()


def test_columns_with_internal_names_stay(spark):
    """Whatever the input calls its columns, they come back as they were."""
    names = ("_id", "_sha256", "own_id", "id", "digest", "_key", "_of", "spans", "c0", "c1", "keep_id")
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, None), (3, None)], "doc_id long, text string").withColumns(
        {n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    index = DigestIndex(spark)
    kept = kept_documents(docs, index)
    index.drop()
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    for result in (kept, without_repeats(docs)):
        assert all(r[n] == f"{n}{r['doc_id']}" for r in result.collect() for n in names)


# ---- vectors and archives --------------------------------------------------------------------------


def test_vectors_of_several_widths(spark):
    """Each width is indexed; vectors of different widths don't meet."""
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(1000, [1.0, 2.0, 3.0]), (1001, [2.0, 4.0, 6.0]), (1002, [1.0, 2.0, 3.1]), (1003, [5.0]), (1004, [7.0]), (1005, [-1.0]), (1006, []), (1007, None)]
    rows += [(2000 + i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(40, 17)))]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()), key=str)
    assert got == brute.vectors(rows)
    assert [g[1:] for g in got if g[0] in (1000, 1001, 1002)] == [(2, 1000)] * 3 and (1004, 1, 1003) in got


def test_a_link_counts_for_both_of_its_vectors(spark):
    """Pairs at the threshold, of which one side's traversal alone comes by many."""
    r = np.random.default_rng(2)
    one = r.normal(size=(1500, 64))
    one /= np.linalg.norm(one, axis=1)[:, None]
    aside = r.normal(size=one.shape)
    aside -= (aside * one).sum(1)[:, None] * one
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    two = 0.9005 * one + np.sqrt(1 - 0.9005**2) * aside
    rows = [(2 * i + k, [float(x) for x in v]) for i, pair in enumerate(zip(one, two, strict=True)) for k, v in enumerate(pair)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.8).collect()
    links, names = {r["vec_id"]: r["n_links"] for r in found}, {r["vec_id"]: r["component_id"] for r in found}
    assert all(links[2 * i] == links[2 * i + 1] == (names[2 * i + 1] == 2 * i) for i in range(1500))
    assert 0.8 * 1500 < sum(links.values()) / 2 < 1500


def test_codebooks_grow_with_the_table():
    assert [codewords_for(n) for n in (0, 1, 50_000, 10**6, 10**9)] == [64, 64, 64, 256, 1024]


def test_archives_that_are_cut_off_are_refused():
    body = bytes(range(256)) * 50
    members = b"".join(gzip.compress(body[i:i + 700]) for i in range(0, len(body), 700))
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    at_a_flush = engine.compress(body) + engine.flush(zlib.Z_SYNC_FLUSH)
    for size in (1, 50, 1 << 16):
        for whole in (gzip.compress(body), members, members + b"\0" * 999, b""):
            assert b"".join(inflated(io.BytesIO(whole), "f", size)) == (body if whole else b"")
        for damaged in (members[:-3], members[:40], members + b"rest", at_a_flush, b"no gzip"):
            with pytest.raises(ValueError, match="the-file"):
                b"".join(inflated(io.BytesIO(damaged), "the-file", size))


@pytest.mark.parametrize("parts", [32, 256, 2048, 211])
def test_slices_are_at_home_everywhere(parts):
    homes = [_home(np.array([task << 24 | number], np.int64), parts) for task in range(200) for number in range(64)]
    sizes = np.bincount(homes, minlength=parts)
    assert sizes.max() < 12_800 / parts * 4 + 12
