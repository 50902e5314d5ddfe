"""The registered queries against their SQL or a model, and the pipeline as its stages one by one."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from newsloom.llm import oracles, queries, toxicity
from tests.llm import brute
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(connect(SF), registry.queries()[name](spark, SF), oracles.ORACLES[name]) == []


def test_jaccard_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in queries.op8_ngram_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect())
    assert found == brute.similar(rows)


def test_all_registered():
    names = registry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_pipeline(spark):
    """Each stage keeps what its operator keeps of the stage before it, and the last packs all of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    tables = {}
    for name, function in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stage(function(spark, kept, SF))
        tables[name] = kept
        if name != "packing":
            assert kept.columns == columns and kept.count() <= docs.count()
    clean = tables["toxicity"]
    bad = {r["doc_id"] for r in queries.op4_toxicity(spark, SF).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    rows = [tuple(r) for r in tables["exact dedup"].select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in tables["n-gram jaccard join"].collect()} == {i for i, _, c in brute.similar(rows) if i == c}
    rows = [tuple(r) for r in tables["n-gram jaccard join"].select("doc_id", "text").collect()]
    before, after = dict(rows), {r["doc_id"]: (r["text"], r["n_chars"]) for r in tables["substring dedup"].collect()}
    shortened = [r for r in brute.substring(rows) if r[2]]
    assert shortened and {i for i, t in before.items() if after[i][0] != t} == {i for i, *_ in shortened}
    assert all(hashlib.sha256(after[i][0].encode()).hexdigest() == kept for i, _, _, kept in shortened)
    assert all(n == len(t) for t, n in after.values())
    whole = tables["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert whole.filter("n <> all").count() == 0 and whole.count() == len(rows)


def test_pipeline_ids(spark):
    """The packing stage returns the token ids that its checksums are of."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    found = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF).select("length", "ids_crc32", "ids").collect()
    assert found and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in found)


@pytest.fixture(scope="module")
def given(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def word_ids(given):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in given.items()}


def test_token_counts_query(spark, given, word_ids):
    expected = sorted((i, len(t.encode()), len(word_ids[i]), len(word_ids[i]) > 2048) for i, t in given.items())
    found = queries.op3_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert sorted(map(tuple, found.collect())) == expected


def test_pieces_query(spark, given):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, model.encode(t)) for i, t in given.items()))
    assert sorted(map(tuple, queries.op6_sentencepiece(spark, SF).select("doc_id", "n_pieces", "ids_crc32").collect())) == expected


def test_packing_query(spark, given, word_ids):
    """Pieces of each document in order are its ids and the end; sequences are powers of two, numbered without gaps."""
    found = queries.op7_packing(spark, SF).collect()
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found))) and {r["offset"] for r in found} == {0}
    places = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.array([*word_ids[r["doc_id"]], 2], "<u4")
        assert r["start"] == places.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        assert r["length"] & (r["length"] - 1) == 0 and 1 <= r["length"] <= 4096
        places[r["doc_id"]] = r["start"] + r["length"]
        assert zlib.crc32(ids[r["start"]:places[r["doc_id"]]].tobytes()) == r["ids_crc32"]
    assert places == {i: len(ids) + 1 for i, ids in word_ids.items()}


def test_toxicity_query_scores(spark, given):
    """The scores of the query are those of its model, gone through n-gram by n-gram."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model.grams.tolist(), model.weights.tolist(), strict=True))
    scores = {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in queries.op4_toxicity(spark, SF).collect()}
    assert scores.keys() == given.keys() and weights

    def hashed(gram):
        h = 0
        for k, c in enumerate(gram):
            point = 32 if 9 <= ord(c) <= 13 else ord(c)
            h = (h + (point + 1) * toxicity._STEPS[k]) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 12
        h = h * 0x297A2D39 % 2**32
        return h ^ h >> 15

    for i, text in list(given.items())[::10]:
        low = text.lower()
        grams = {hashed(low[k:k + n]) for n in toxicity.ORDERS for k in range(len(low) - n + 1)}
        total = model.intercept + sum(weights.get(g, 0.0) for g in grams)
        expected = 1 / (1 + np.exp(-total))
        assert scores[i] == (pytest.approx(expected), int(expected >= 0.5), zlib.crc32(str(i).encode()) % 5 == 0)
