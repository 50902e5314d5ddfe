"""Tables dealt into folders, and what is kept in them: recency of threads, answered requests."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import reactions
from newsloom.operators.recency import Recency
from newsloom.operators.replay import RequestIndex, apply_once
from newsloom.plans import views
from newsloom.session import stage
from newsloom.sources.buckets import BucketTable

SF = "/root/testdata/sf0.001"
DAY = datetime(2026, 1, 1)
LOG = "type string, object_id string, thread_root string, received_at timestamp"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_opens_its_own_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, "k", "k string, v bigint", buckets=16)
    assert table.read().count() == 0 and table.read([1]).count() == 0
    df = spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    table.replace(df, table.touched(df.select("k")))
    assert rows(table.read()) == rows(df) and BucketTable(spark, path, "k", "k string, v bigint").buckets == 16
    before = files(path)
    some = df.filter("k = 'k7'")
    mine = table.touched(some.select("k"))
    held = table.read(mine)
    n = held.count()
    assert len(mine) == 1 and 0 < n < 60 and {f.split("bucket=")[1].split("/")[0] for f in held.inputFiles()} == {str(mine[0])}
    table.replace(held.filter("k <> 'k7'"), mine)
    assert rows(table.read()) == rows(df.filter("k <> 'k7'"))
    assert {f for f, t in before.items() if files(path).get(f) == t} == {f for f in before if f"bucket={mine[0]}/" not in f}
    table.replace(df.limit(0), mine)
    assert not [f for f in files(path) if f"bucket={mine[0]}/" in f]
    table.rebuild(64)
    assert BucketTable(spark, path, "k", "k string, v bigint", buckets=16).buckets == 64 and table.read().count() == 200 - n
    with pytest.raises(ValueError):
        table.rebuild(8)


def test_recency_in_pieces_equals_the_whole_log(spark, tmp_path):
    """Any order of pieces, each twice: what is kept is what the whole log gives."""
    r = random.Random(8)
    log = []
    for n in range(600):
        kind, thing = r.choice(["Like", "Dislike", "Create", "Update", "Create", "Delete" if r.random() < 0.3 else "Like"]), f"o{r.randrange(60)}"
        root = f"a{r.randrange(8)}" if kind in ("Create", "Like") and r.random() < 0.7 else None
        log.append((kind, None if r.random() < 0.02 else thing, root, DAY + timedelta(minutes=r.randrange(10_000))))
    whole = spark.createDataFrame(log, LOG)
    kept = Recency.at(spark, str(tmp_path / "r"), 8)
    for piece in (log[400:], log[:200], log[200:400], log[:200]):
        kept.advance(spark.createDataFrame(piece, LOG))
    expected = [x for x in rows(reactions.last_activity(whole)) if x[0] is not None]
    assert rows(kept.last_activity()) == expected


def test_a_deletion_retracts_its_threads_only(spark, tmp_path):
    path = str(tmp_path / "r")
    kept = Recency.at(spark, path, 64)
    first = [("Create", f"c{n}", f"a{n % 20}", DAY + timedelta(hours=n)) for n in range(100)]
    assert kept.advance(spark.createDataFrame(first, LOG)).count() == 20
    before = files(path)
    changes = kept.advance(spark.createDataFrame([("Delete", "c99", None, DAY + timedelta(days=9)), ("Delete", "unknown", None, DAY)], LOG))
    assert rows(changes) == [("a19", DAY + timedelta(hours=79))]
    changed = {f for f, t in before.items() if files(path).get(f) != t}
    assert 0 < len(changed) < len(before) / 4
    # what is deleted stays so, also for rows that come later, and a thread without entries is told as such
    assert rows(kept.advance(spark.createDataFrame([("Like", "c99", "a19", DAY + timedelta(days=30))], LOG))) == [("a19", DAY + timedelta(hours=79))]
    rest = [("Delete", f"c{n}", None, DAY) for n in (19, 39, 59, 79)]
    assert rows(kept.advance(spark.createDataFrame(rest, LOG))) == [("a19", None)]


def test_an_interrupted_advance_is_repeated(spark, tmp_path, monkeypatch):
    """A run that stops between its two writes leaves the deletion new for the next one."""
    kept = Recency.at(spark, str(tmp_path / "r"), 4)
    kept.advance(spark.createDataFrame([("Create", "c", "a", DAY), ("Create", "d", "a", DAY - timedelta(days=1))], LOG))
    fresh = spark.createDataFrame([("Delete", "c", None, DAY)], LOG)

    def stopped(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(kept.objects, "replace", stopped)
    with pytest.raises(RuntimeError):
        kept.advance(fresh)
    again = Recency.at(spark, str(tmp_path / "r"), 4)
    assert rows(again.advance(fresh)) == [("a", DAY - timedelta(days=1))]
    assert rows(again.last_activity()) == [("a", DAY - timedelta(days=1))]


def test_recency_of_the_given_log(spark, tmp_path):
    log = views.activities(spark, SF)
    kept = Recency.at(spark, str(tmp_path / "r"), 4)
    kept.advance(log.filter("received_at >= timestamp'2024-01-15 00:00:00'"))
    kept.advance(log.filter("received_at < timestamp'2024-01-15 00:00:00'"))
    expected = reactions.last_activity(log).select("id", F.col("last_activity_at").cast("timestamp"))
    assert rows(kept.last_activity()) == rows(expected)


# ---- answered requests -----------------------------------------------------------------------------


def answers(spark, first, last, status=201):
    return spark.range(first, last).select(
        F.concat(F.lit("r"), "id").alias("request_id"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("reason"),
        F.concat(F.lit("a"), "id").alias("activity_id"), F.lit(None).cast("string").alias("result_id"))


def test_the_filter_denies_no_known_id(spark, tmp_path):
    index = RequestIndex.at(spark, str(tmp_path / "i"), buckets=4, blocks=16)
    assert index.answered(answers(spark, 0, 5)).count() == 0
    index.add(answers(spark, 0, 3000))
    index.add(answers(spark, 2000, 5000, 200))
    assert rows(index.answers.read().groupBy("status").count()) == [(200, 2000), (201, 3000)]
    assert index.maybe_known(answers(spark, 0, 5000)).count() == 5000
    assert index.maybe_known(answers(spark, 10_000, 30_000)).count() < 400
    assert [r[0] for r in rows(index.answered(answers(spark, 4995, 5005)))] == [f"r{n}" for n in range(4995, 5000)]
    index.add(answers(spark, 0, 5000))
    assert index.answers.read().count() == 5000


def test_new_ids_open_no_answers(spark, tmp_path):
    index = RequestIndex.at(spark, str(tmp_path / "i"), buckets=8, blocks=64)
    index.add(answers(spark, 0, 500))
    assert index.answers.touched(index.maybe_known(answers(spark, 1000, 1020))) == []


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    """Also after a later opposite reaction, and mixed with new requests."""
    objects = spark.createDataFrame(
        [("o", "hs", DAY, DAY, False, '{"type":"Article","id":"o"}')], "id string, source string, published timestamp, updated timestamp, deleted boolean, object_json string"
    ).withColumns({"like_count": F.lit(0).cast("long"), "dislike_count": F.lit(0).cast("long"), "tags": F.array().cast("array<string>"),
                   "tags_enriched": F.lit(False), "og_enriched": F.lit(False), "og_enriched_error": F.lit(None).cast("string")})
    likes = spark.createDataFrame([], "activity_id string, actor string, object_id string, reaction_type string, published timestamp")
    schema = "request_id string, type string, actor string, object_id string, object_json string, received_at timestamp"
    index = RequestIndex.at(spark, str(tmp_path / "i"), buckets=2, blocks=4)
    like, dislike, other = ((i, t, u, "o", None, DAY + timedelta(hours=h)) for i, t, u, h in (
        ("r1", "Like", "u", 1), ("r2", "Dislike", "u", 2), ("r3", "Like", "v", 3)))
    seen, logged = [], []
    for batch in ([like], [dislike], [like, dislike, other, like]):
        outcome, replayed = apply_once(spark.createDataFrame(batch, schema), objects, likes, index)
        logged += [r["id"] for r in outcome.activities.collect()]
        seen.append((rows(outcome.decided.select("request_id", "status")), rows(replayed.select("request_id", "status"))))
        likes = stage(outcome.likes)
        index.add(outcome.decided)
    assert seen == [([("r1", 201)], []), ([("r2", 201)], []), ([("r3", 201)], [("r1", 201), ("r2", 201)])]
    assert len(logged) == len(set(logged)) == 3
    assert rows(likes.select("actor", "reaction_type")) == [("u", "Dislike"), ("v", "Like")]


def test_folders_are_packed(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k", "k string, v bigint", buckets=4)
    table.replace(spark.range(50).selectExpr("cast(id as string) k", "id v"), [0, 1, 2, 3])
    assert files(table.path) and all(name.endswith(".zstd.parquet") for name in files(table.path))
