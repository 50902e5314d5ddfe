"""Leaving users in documents, and state from snapshots."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from newsloom.operators import variants
from newsloom.plans import views

SF = "/root/testdata/sf0.001"


def hide(spark, documents, *actors):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(documents)], "id string, object_json string")
    leaving = spark.createDataFrame([(a,) for a in actors], "actor string")
    out = variants.anonymised(df, leaving, salt="s").collect()
    return [r["object_json"] for r in sorted(out, key=lambda r: int(r["id"]))]


def name(spark, actor):
    return spark.range(1).select(variants.hidden_name(F.lit(actor), "s")).first()[0]


def test_ids_are_found_however_they_are_written(spark):
    user, other = "https://ex.org/users/u1", "https://ex.org/users/u12"
    documents = [
        json.dumps({"actor": user}), '{"actor":"https:\\/\\/ex.org\\/users\\/u1"}', '{"actor":"https://ex.org/\\u0075sers/u1"}',
        json.dumps({"deep": [{"x": {"y": [user + "/outbox", user + "#key", user + "?page=1"]}}]}), json.dumps({user: 1}),
        json.dumps({"content": f"so says {user}, and <a href='{user}'>he</a>, {user}."}), json.dumps({"actor": other, "x": "u1", "y": "users/u1"}),
        f"no document but {user}", None, "",
    ]
    hidden = name(spark, user)
    out = hide(spark, documents, user)
    assert [json.loads(d) for d in out[:5]] == [
        {"actor": hidden}, {"actor": hidden}, {"actor": hidden},
        {"deep": [{"x": {"y": [hidden + "/outbox", hidden + "#key", hidden + "?page=1"]}}]}, {hidden: 1}]
    assert json.loads(out[5]) == {"content": f"so says {hidden}, and <a href='{hidden}'>he</a>, {hidden}."}
    assert out[6:] == [documents[6], f"no document but {hidden}", None, ""]


def test_an_id_that_begins_another_one(spark):
    one, two = "https://ex.org/a", "https://ex.org/a/b"
    out = json.loads(hide(spark, [json.dumps({"x": [one, two, two + "/c", one + "/z"]})], one, two)[0])
    first, second = name(spark, one), name(spark, two)
    assert out == {"x": [first, second, second + "/c", first + "/z"]}


def test_short_ids_with_special_characters(spark):
    out = hide(spark, [json.dumps({"x": "users/1", "y": "users/11", "z": "https://h/users/1/in", "w": "a$b (c)"})], "users/1", "a$b (c)")
    hidden = name(spark, "users/1")
    assert json.loads(out[0]) == {"x": hidden, "y": "users/11", "z": f"https://h/{hidden}/in", "w": name(spark, "a$b (c)")}


def test_a_snapshot_and_the_tail_equal_the_log(spark, tmp_path):
    log = views.activities(spark, SF)
    stored = str(tmp_path / "log")
    log.repartitionByRange(12, "received_at").sortWithinPartitions("received_at").write.parquet(stored)
    log = spark.read.parquet(stored)
    kept = variants.StateSnapshots(spark, str(tmp_path / "snapshots"))
    expected = sorted(map(tuple, variants.state_from_log(log).collect()), key=str)
    assert sorted(map(tuple, kept.current(log).collect()), key=str) == expected
    for day in (10, 20, 25):
        kept.take(log, datetime(2024, 1, day))
        assert sorted(map(tuple, kept.current(log).collect()), key=str) == expected
    assert kept.moments() == [datetime(2024, 1, d) for d in (10, 20, 25)]
    plan = kept.current(log)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(received_at,2024-01-25T00:00)" in plan
    # a snapshot that was not written to its end is no snapshot, and is taken again
    os.remove(tmp_path / "snapshots" / "before-20240125T000000" / "_SUCCESS")
    assert kept.moments()[-1] == datetime(2024, 1, 20)
    kept.take(log, datetime(2024, 1, 25))
    assert sorted(map(tuple, kept.current(log).collect()), key=str) == expected


def test_the_tail_alone_is_read(spark, tmp_path):
    """Rows of before the snapshot can be gone from the log."""
    log = views.activities(spark, SF)
    kept = variants.StateSnapshots(spark, str(tmp_path / "snapshots"))
    kept.take(log, datetime(2024, 1, 20))
    tail = log.filter("received_at >= timestamp_ntz'2024-01-20 00:00:00'")
    assert sorted(map(tuple, kept.current(tail).collect()), key=str) == sorted(map(tuple, variants.state_from_log(log).collect()), key=str)
