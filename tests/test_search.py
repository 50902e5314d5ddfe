import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import postings, search
from newsloom.sources.tables import read_table, write_table
from tests.test_merge import _objects, rows

DAY = datetime(2026, 1, 1)


@pytest.fixture
def objects(spark):
    from datetime import datetime

    d = [datetime(2026, 1, day) for day in range(1, 9)]
    return _objects(spark, [
        dict(id="dup", tags=["x", "x", "y"], published=d[0], like_count=0, object_json='{"name":"d"}'),
        dict(id="one", tags=["x"], published=d[1], like_count=9, object_json='{"name":"o","likes":1}'),
        dict(id="nodoc", tags=["x"], published=d[1], like_count=8, object_json=None),
        dict(id="bad", tags=["y"], published=d[2], like_count=7, object_json="{bad"),
        dict(id="late", tags=["y"], published=d[3], updated=d[4], like_count=1, object_json='{"name":"l"}'),
        dict(id="early", tags=["y"], published=d[3], updated=d[3], like_count=1, object_json='{"name":"e"}'),
        dict(id="gone", tags=["x", "y"], published=d[3], deleted=True),
        dict(id="none", tags=[], published=d[3]),
    ])


def test_ranking_counts_repeated_object_tags_but_not_repeated_search_tags(objects):
    rows = search.outbox(objects, [" X ", "x"], 10).collect()
    assert [(r.id, r.relevance) for r in rows] == [("dup", 2), ("one", 1), ("nodoc", 1)]


def test_order_and_dropping_unreadable_documents_after_the_limit(objects):
    ids = [r.id for r in search.outbox(objects, ["x", "y"], 6).collect()]
    assert ids == ["dup", "one", "nodoc", "bad", "late", "early"]
    items = search.outbox_items(objects, ["x", "y"], 5).collect()
    assert [r.id for r in items] == ["dup", "one", "late"]
    assert json.loads(items[1].document)["likes"] == 9
    assert json.loads(items[2].document)["updated"] == "2026-01-05T00:00:00Z" and "updated" not in json.loads(items[1].document)
    assert search.total_items(objects, ["x", "y"]).first()[0] == 6


def test_collection_document(objects):
    tags = ["X", "y"]
    row = search.outbox_document(search.outbox_items(objects, tags, 5), search.total_items(objects, tags), tags, 5).first()
    document = json.loads(row.document)
    assert document["type"] == "OrderedCollection" and document["totalItems"] == 6
    assert document["id"] == "https://example.org/ap/outbox?tag=x&tag=y&n=5"
    assert [item["name"] for item in document["orderedItems"]] == ["d", "o", "l"]


def test_bounds(objects):
    for n in (0, 501, -1):
        with pytest.raises(ValueError):
            search.outbox(objects, ["x"], n)
    for tags in ([], [" ", ""]):
        with pytest.raises(ValueError):
            search.outbox(objects, tags)


def test_many_searches_equal_single_searches(spark, objects):
    wanted = [("a", ["x", "y", "x"], 3), ("b", [" Y"], None), ("c", ["zz"], 5), ("d", [" "], 5)]
    table = spark.createDataFrame(wanted, "search_id string, tags array<string>, n int")
    many = search.outbox_many(objects, table).orderBy("search_id", "place").collect()
    for name, tags, n in wanted[:3]:
        single = [(r.id, r.relevance) for r in search.outbox(objects, tags, n or 50).collect()]
        assert [(r.id, r.relevance) for r in many if r.search_id == name] == single
    assert {r.search_id for r in many} == {"a", "b"}


def test_plans_read_narrow_rows_and_prune_the_second_scan(spark, objects, tmp_path):
    write_table(objects, str(tmp_path), "objects")
    stored = read_table(spark, str(tmp_path), "objects")
    top = search.outbox(stored, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "Exchange" not in top and "object_json" not in top
    items = search.outbox_items(stored, ["x", "y"], 5)
    assert [r.id for r in items.collect()] == ["dup", "one", "late"]
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    many = search.outbox_many(stored, spark.createDataFrame([("a", ["x"])], "search_id string, tags array<string>"))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan


def test_searches_that_cannot_be_answered_say_why(spark, objects):
    """Bounds and blank tags have a status; tabs, line feeds and repeats mean what they mean for a single search."""
    rows = [("ok", ["\tX\n", "x", " "], 2), ("default", ["y"], None), ("many", ["x"], 501), ("zero", ["x"], 0), ("blank", [" ", "\n"], 5), ("none", None, 5)]
    searches = spark.createDataFrame(rows, "search_id string, tags array<string>, n int")
    checked = {r.search_id: (r.status, r.reason) for r in search.checked_searches(searches).collect()}
    assert checked == {
        "ok": (200, None), "default": (200, None), "many": (400, "n must be between 1 and 500"), "zero": (400, "n must be between 1 and 500"),
        "blank": (400, "at least one tag is required"), "none": (400, "at least one tag is required"),
    }
    found = search.outbox_many(objects, searches).orderBy("place").collect()
    assert [r.id for r in found if r.search_id == "ok"] == [r.id for r in search.outbox(objects, ["\tX\n", "x"], 2).collect()]
    url = search.normalised_searches(searches).filter("search_id = 'ok'").select(search.search_url(F.col("tags"), F.col("n"))).first()[0]
    assert url == search.self_url(search.normalise_tags(["\tX\n", "x", " "]), 2)


def test_postings_equal_the_pairs(spark):
    """Ties, repeated tags, deleted objects, NULL times and tags, searches without answers; blocks of any size."""
    r = random.Random(4)
    objects = _objects(spark, [
        dict(id=f"o{n:03}", like_count=r.randrange(4), deleted=n % 17 == 0, updated=r.choice([None, DAY, DAY + timedelta(days=n % 5)]),
             published=r.choice([None, DAY]), tags=[r.choice("abcdefgh") for _ in range(r.randrange(6))]) for n in range(400)])
    searches = spark.createDataFrame([
        ("one", ["a"], 3), ("two", ["a", "b"], 500), ("rare", ["h", "zz"], 7), ("none", ["zz"], 5), ("bad", [" "], 5), ("many", list("abcdefgh"), 20),
        ("most", list("abc"), None), ("first", ["c", "d"], 1)], "search_id string, tags array<string>, n int")
    expected = rows(search.outbox_many(objects, searches))
    for block in (1, 7, 64, 1000):
        found = postings.search_postings(postings.build_postings(objects, block), searches, opened=1)
        assert sorted(found.columns) == sorted(search.outbox_many(objects, searches).columns)
        assert rows(found.select(search.outbox_many(objects, searches).columns)) == expected
    nothing = postings.search_postings(postings.build_postings(objects.limit(0)), searches)
    assert nothing.count() == 0 and postings.search_postings(postings.build_postings(objects), searches.limit(0)).count() == 0


def test_common_tags_do_not_form_the_product(spark):
    """A tag that all objects have, in every search: the pairs formed stay near what is asked for."""
    n = F.col("id")
    objects = spark.range(20_000).select(
        F.concat(F.lit("o"), n).alias("id"), F.lit("hs").alias("source"), F.lit(DAY).alias("published"), F.lit(DAY).alias("updated"),
        (F.xxhash64(n) % 50).alias("like_count"), F.lit(False).alias("deleted"),
        F.when(n % 3 == 0, F.array(F.lit("all"), F.lit("third"))).otherwise(F.array(F.lit("all"))).alias("tags"))
    searches = spark.range(30).select(
        F.concat(F.lit("s"), n).alias("search_id"), F.when(n % 2 == 0, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("third"))).alias("tags"),
        F.lit(10).alias("n"))
    trace = []
    found = postings.search_postings(postings.build_postings(objects), searches, trace=trace)
    columns = ["search_id", "id", "relevance", "place"]
    assert rows(found.select(columns)) == rows(search.outbox_many(objects, searches).select(columns))
    assert sum(trace) <= 30 * 512 < 30 * 20_000 / 30
