"""Every operator against a brute-force model, on texts made to be awkward and on given tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import jaccard, queries, substring
from newsloom.llm.backoff import backoff_scores
from newsloom.llm.components import components
from newsloom.llm.exact_dedup import DigestIndex, exact_dedup, kept_documents
from newsloom.llm.jaccard import similar_documents, similar_pairs, without_near_copies
from newsloom.llm.multi_index import near_vectors
from newsloom.llm.packed import pack
from newsloom.llm.packing import packed_sequences
from newsloom.llm.pieces import decoded, encoded, piece_counts
from newsloom.llm.substring import span_table, substring_dedup, without_repeats
from newsloom.llm.tokens import WordTokens, token_counts
from newsloom.llm.toxicity import toxicity, without_toxic
from newsloom.llm.warc import archived_pages
from tests.llm import brute

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXT = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies of one base, a passage many share, repeats inside a text, odd white space, empty texts."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "日本", "a.b", "x!"]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base, passage = draw(120), draw(30)
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((3 * i, " ".join(w)))
    rows += [(1000 + i, " ".join(draw(r.randint(0, 30)) + passage + draw(r.randint(0, 30)))) for i in range(30)]
    rows += [(1100 + i, "same text\tas  before") for i in range(40)]
    rows += [(1200, " ".join(passage + passage)), (1201, "En " * 300), (1202, "\n \t"), (1203, ""), (1204, None), (1205, "one"),
             (1206, "A b C"), (1207, "a B c"), (1208, "a b c d e"), (1209, " lead and trail "), (1210, "x" * 3000), (-5, " ".join(base)),
             (1211, " ".join(draw(9000)))]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    """The rows over several partitions, with columns whose names an operator might use itself."""
    return spark.createDataFrame(rows, TEXT).repartition(3).withColumns({n: F.lit("x") for n in ("n", "part", "score", "spans", "c0", "key")})


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: [(x is not None, x) for x in t])


def test_substring(spark, texts):
    docs = frame(spark, texts)
    expected = brute.substring(texts)
    assert got(substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    shorter = without_repeats(docs)
    assert shorter.columns == docs.columns
    changed = {i: h for i, _, n, h in expected if n}
    found = {r["doc_id"]: r["text"] for r in shorter.collect()}
    assert all(hashlib.sha256(found[i].encode()).hexdigest() == h for i, h in changed.items())
    assert all(found[i] == t for i, t in texts if i not in changed)
    covered = {}
    words = {i: brute.WORD.findall(t or "") for i, t in texts}
    for r in span_table(docs).collect():
        mine, other = words[r["doc_id"]][r["start"]:r["start"] + r["n_words"]], words[r["source_id"]]
        assert mine == other[r["source_start"]:r["source_start"] + r["n_words"]]
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    assert {i: len(c) for i, c in covered.items()} == {i: n for i, _, n, _ in expected if n}


def test_substring_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = got(substring_dedup(frame(spark, [(4, text), (4, text), (None, text), (7, "short")])), "doc_id", "n_removed")
    assert rows == [(None, 25), (4, 0), (4, 0), (7, 0)]


def test_substring_false_sources(spark, monkeypatch):
    """Windows that the graph takes for equal but whose words differ are not removed; those that are equal are."""
    one, two = " ".join(f"a{i}" for i in range(25)), " ".join(f"b{i}" for i in range(25))
    docs = frame(spark, [(1, one), (2, two), (3, one)])
    spans = [np.array(x, t) for x, t in (([0], "i8"), ([6], "i8"), ([0], "u8"), ([1], "i8"), ([0], "i8"))]
    claimed = spark.createDataFrame([(2, bytearray(pack(*spans))), (3, bytearray(pack(*spans)))], substring.SPANS)
    monkeypatch.setattr(substring, "repeated_spans", lambda *_: claimed)
    assert got(substring_dedup(docs), "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 25)]


def test_exact(spark, texts):
    docs = frame(spark, texts)
    normal = {i: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    groups = {}
    for i, t in normal.items():
        groups.setdefault(t, []).append(i)
    expected = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in normal.items())
    assert got(exact_dedup(docs, DigestIndex(spark, buckets=4)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected
    kept = kept_documents(docs, DigestIndex(spark, buckets=4))
    assert kept.columns == docs.columns
    assert got(kept, "doc_id") == [(i,) for i, _, _, k, _ in expected if k]


def test_exact_batches(spark):
    """What an earlier batch put in the index stays; the same batch again changes nothing."""
    index = DigestIndex(spark, buckets=4)
    one, two = frame(spark, [(5, "a b"), (6, "c")]), frame(spark, [(1, "a  b"), (2, "d"), (3, "d")])
    assert [r[:2] for r in got(exact_dedup(one, index), "doc_id", "keep_id")] == [(5, 5), (6, 6)]
    for _ in range(2):
        assert got(exact_dedup(two, index), "doc_id", "keep_id", "kept") == [(1, 5, False), (2, 2, True), (3, 2, False)]
    assert index.read().count() == 3
    assert got(exact_dedup(frame(spark, [(None, "z"), (9, "z"), (None, None)]), DigestIndex(spark)), "doc_id", "keep_id", "kept") == [
        (None, None, True), (None, 9, False), (9, 9, True)]
    index.drop()
    rows = [(None, "p"), (None, "q"), (None, "q"), (4, "r"), (4, "s"), (4, "r"), (5, "r")]
    kept = kept_documents(frame(spark, rows), DigestIndex(spark))
    assert got(kept, "doc_id", "text") == [(None, "p"), (None, "q"), (4, "r"), (4, "s")]


def test_similar(spark, texts):
    docs = frame(spark, texts)
    expected = brute.similar(texts)
    assert got(similar_documents(docs), "doc_id", "n_shingles", "component_id") == expected
    assert got(without_near_copies(docs), "doc_id") == [(i,) for i, _, c in expected if i == c]
    assert got(similar_documents(frame(spark, [(None, "a b"), (3, "A B"), (3, "A B"), (None, "q")])), "doc_id", "component_id") == [
        (None, None), (None, 3), (3, 3), (3, 3)]


def test_similar_links(spark, texts, monkeypatch):
    """Every link counts and comes back, also inside a component, within a block and between blocks."""
    sets = {i: frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))
            for i, t in texts for w in [brute.WORD.findall((t or "").translate(brute.LOWER))]}
    linked = {(a, b) for a in sets for b in sets if a != b and sets[a] and jaccard.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))}
    names = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    expected = sorted({(names[sets[a]], names[sets[b]]) for a, b in linked if names[sets[a]] < names[sets[b]]})
    docs = frame(spark, [*texts, *texts[:90], (None, texts[0][1])])
    for block in (1024, 8):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert got(similar_pairs(docs), "a", "b") == expected
        assert {r["doc_id"]: r["n_links"] for r in similar_documents(docs).collect()} == {
            None: 0} | {i: sum(a == i for a, _ in linked) for i in sets}


def test_similar_blocks(spark, monkeypatch):
    """A source whose texts share most of a template: few sets are sent anywhere, and no task holds more than two blocks."""
    r = random.Random(9)
    template = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(template[:r.randint(80, 100)] + [f"u{i}_{k}" for k in range(22)])) for i in range(400)]
    rows += [(1000 + i, " ".join(template + [f"v{i}_{k}" for k in range(r.randint(4, 24))])) for i in range(60)]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    docs = frame(spark, rows)
    assert got(similar_documents(docs), "doc_id", "n_shingles", "component_id") == brute.similar(rows)
    # The lists of one shingle of all texts, in one block of 400 and in two of a narrow size each.
    for place, sent in ((22, 0), (2, 400)):
        batch = pa.RecordBatch.from_pydict({
            "h": np.zeros(400, np.int64), "block": np.arange(400) // 200, "id": np.arange(400), "n": np.full(400, 110), "place": np.full(400, place)})
        assert sum(b.num_rows for b in jaccard._met(iter([batch]))) == 2 * sent
    batches = [pa.RecordBatch.from_pydict({"low": [1, 1, 2], "high": [5, 5, 5]}), pa.RecordBatch.from_pydict({"low": [2, 3], "high": [5, 5]})]
    assert [t.num_rows for t in jaccard._groups(iter(batches))] == [2, 2, 1]


def test_shared_counts():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 40 + 60 * (i % 9), 60)).astype(np.uint64) for i in range(90)]
    a, b = sets[:40], sets[40:]
    found = jaccard._shared([x.tobytes() for x in a], [x.tobytes() for x in b])
    assert (found == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]
    found = dict(got(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30)) and found[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + r.normal(size=8) * 0.15]) for i in range(200)]
    rows += [(500 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for i in range(20)] + [(530, [2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 16.0])]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [None] + [1.0] * 7), (604, [float("nan")] * 8), (605, [float("inf")] * 8), (606, [1.0]),
             (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("size", F.lit("x"))
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in near_vectors(df, codewords=4, block=32, recall=1.0).collect()), key=str) == (
        brute.vectors(rows))
    assert near_vectors(df.limit(0)).count() == 0


def test_vector_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = {i: n for i, n, _ in brute.vectors(rows)}
    found = {r["vec_id"]: r["n_links"] for r in queries.op2_embedding_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert sorted(found) == sorted(expected) and all(found[i] <= n for i, n in expected.items())
    assert sum(found.values()) >= 0.9 * sum(expected.values())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_tokens(spark, texts, library):
    rows = [*texts, (2000, "<|endoftext|> x<|endoftext|>y \x01 a\x01b"), (2001, "İSTANBUL ǅ 1a2b3c it's é"), (None, "a")]
    expected = sorted(((i, len((t or "").encode()), n, n > 2048) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]),
                      key=lambda t: [(x is not None, x) for x in t])
    for chunk in (32_768, 700):
        assert got(token_counts(frame(spark, rows), WORDS, chunk=chunk), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def test_long_texts(library):
    tokens = WordTokens.of(WORDS)
    r = random.Random(1)
    for alphabet in ("ab ", "a1", "'s t<|endoftext|>", "xyz"):
        text = "".join(r.choice(alphabet) for _ in range(3000))
        assert tokens.long_count(text, 100, 8) == len(library.encode(text, add_special_tokens=False).ids)


def test_packing(spark, texts, library):
    rows = [*texts, (None, "a b"), (1205, "one")]
    found = packed_sequences(frame(spark, rows), WORDS, with_ids=True).collect()
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
    pieces = {}
    for r in found:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[i], key=lambda r: r["start"])
        copies = sum(r["start"] == 0 for r in mine)
        whole = b"".join(bytes(r["ids"]) for r in mine[::copies])
        assert whole == ids.tobytes() and all(r["doc_tokens"] == len(ids) for r in mine)
    order = sorted(found, key=lambda r: r["sequence_id"])
    assert all(a["length"] >= b["length"] for a, b in zip(order, order[1:], strict=False))


def test_pieces(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*texts, (2000, "a ▁b\n\n  \tc;\r\n<s> 😀"), (None, " ")]
    docs = frame(spark, rows)
    expected = {i: library.encode(t or "") for i, t in rows}
    for r in piece_counts(docs, PIECES).collect():
        ids = expected[r["doc_id"]]
        assert (r["n_pieces"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    codes = encoded(docs, PIECES)
    assert {r["doc_id"]: r["ids"] for r in codes.collect()} == expected
    assert {r["doc_id"]: r["text"] for r in decoded(codes, PIECES).collect()} == {i: library.decode(x) for i, x in expected.items()}


def test_scores(spark, texts):
    rows = [*texts, (None, "a b"), (1205, "one")]
    expected = sorted(brute.scores(rows), key=lambda t: [(x is not None, x) for x in t])
    found = got(backoff_scores(frame(spark, rows)), "doc_id", "n_words", "log_score")
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected])


def test_scores_back_off(spark, texts):
    """Against counts of another corpus: three words, else two, else one, else a word never seen; the same corpus as before."""
    rows = [*texts, (None, "a b"), (1205, "one"), (3000, "same text as never before"), (3001, "zz zz zz")]
    corpus = [*texts[::3], (1, "same text as before"), (None, "b c a b")]
    count, n = {}, 0
    padded = lambda t: ["<s>", "<s>", *brute.WORD.findall(t or "")]
    for _, t in corpus:
        w = padded(t)
        n += len(w) - 2
        for k in range(2, len(w)):
            for size in (1, 2, 3):
                for key in ((size, *w[k - size + 1:k + 1]), ("after", *w[k - size + 1:k])):
                    count[key] = count.get(key, 0) + 1
    expected = []
    for i, t in rows:
        w, total = padded(t), 0
        for k in range(2, len(w)):
            for size in (3, 2):
                if (size, *w[k - size + 1:k + 1]) in count:
                    total += np.log(0.4 ** (3 - size) * count[size, *w[k - size + 1:k + 1]] / count["after", *w[k - size + 1:k]])
                    break
            else:
                total += np.log(0.4 ** 2 * count.get((1, w[k]), 1) / n)
        expected.append((i, len(w) - 2, total if len(w) > 2 else None))
    expected.sort(key=lambda t: [(x is not None, x) for x in t])
    found = got(backoff_scores(frame(spark, rows), counted=frame(spark, corpus)), "doc_id", "n_words", "log_score")
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected])
    same = got(backoff_scores(frame(spark, rows), counted=frame(spark, rows)), "doc_id", "n_words", "log_score")
    assert [r[2] for r in same] == pytest.approx([r[2] for r in got(backoff_scores(frame(spark, rows)), "doc_id", "n_words", "log_score")])


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.op4_toxicity(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in found)
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([np.mean(np.array(clean) < s) for s in toxic]) > 0.95
    assert np.mean(np.array(clean) < 0.5) > 0.98


def test_toxicity_edges(spark):
    docs = frame(spark, [(i, f"nice day number {i}" if i % 2 else f"you idiot number {i}") for i in range(60)] + [(None, None), (90, ""), (91, None)])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None), (90, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    assert all(found[i]["predicted"] == 1 - i % 2 for i in range(60)) and found[None]["held_out"] and found[90]["score"] == found[91]["score"]
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and all(i is None or i > 60 or i % 2 for i, in got(kept, "doc_id"))
    assert {r["predicted"] for r in toxicity(docs, labels.filter("toxic = 0")).collect()} == {0}
    assert toxicity(docs, labels.limit(0)).count() == 63


def test_warc(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb: c", "x\r\n\r\ny"), (4, "ü", "x\r\n\r\ny"), (None, "z", "x\r\n\r\ny"), (6, "l", "é" * 1_500_000),
            (5, "l", "é" * 1_500_000), (8, "m", "x"), (8, "m", "x"), (7, "m", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).withColumn("digest", F.lit(1))
    found = archived_pages(df).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == brute.archive(rows)
    assert archived_pages(df.limit(0)).count() == 0
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    found = queries.op10_warc(spark, SF).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == brute.archive(pages)


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).filter("doc_id = 0")
    for result in (substring_dedup(none), exact_dedup(none, DigestIndex(spark)), similar_documents(none), token_counts(none, WORDS),
                   packed_sequences(none, WORDS), piece_counts(none, PIECES), backoff_scores(none)):
        assert result.count() == 0
