import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import enrichment, quality, state
from newsloom.operators.recency import Recency
from newsloom.plans import refresh, views
from newsloom.session import configure, stage
from newsloom.sources import manifest, tables
from newsloom.sources.feeds import parse_feeds
from newsloom.sources.pages import extract_page_metadata
from tests.test_merge import _objects, rows

SF = "/root/testdata/sf0.001"


def test_all_jobs_in_order(spark):
    feeds = views.feed_xml(spark, SF)
    empty = _objects(spark, [dict(id="x", source="old")]).filter("false")
    log = views.activities(spark, SF)
    links = parse_feeds(feeds).select("link").distinct()
    pages = links.select(F.col("link").alias("url"), F.lit('<meta property="og:image" content="https://img/og.png"><title>t</title>').alias("html"))
    result = stage(refresh.refresh(empty, feeds=feeds, pages=pages, activities=log, as_of=views.as_of()))
    assert result.count() == links.count() == result.select("id").distinct().count()
    row = result.filter("size(tags) > 0").first()
    assert row.tags_enriched and row.og_enriched and row.og_enriched_error is None
    assert json.loads(row.object_json)["image"]["url"] == "https://img/og.png"
    # running the jobs again changes nothing
    again = refresh.refresh(result, feeds=feeds, pages=pages, activities=log, as_of=views.as_of())
    assert rows(again) == rows(result)


def test_only_newer_items_are_taken_and_markers_move_after_success(spark):
    feeds = views.feed_xml(spark, SF)
    empty = _objects(spark, [dict(id="x")]).filter("false")
    config = spark.createDataFrame(
        [("rss.hs.last_fetched_at", "2024-01-02T00:00:00Z", None, None)], "key string, value string, updated_at timestamp, updated_by string"
    )
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    taken = refresh.ingest(empty, feeds, config=config, now=now)
    wanted = parse_feeds(feeds).filter(
        F.col("published") > F.when(F.col("source") == "hs", F.lit("2024-01-02").cast("timestamp")).otherwise(F.lit("2024-01-02").cast("timestamp"))
    )
    assert taken.count() == wanted.select("link").distinct().count() > 0
    moved = refresh.fetched(config, feeds, F.lit("2024-01-03T00:00:00Z"), now)
    assert {r.value for r in moved.collect()} == {"2024-01-03T00:00:00Z"}
    assert moved.count() == feeds.select("source").distinct().count()


def test_only_items_that_are_taken_are_cleaned(spark):
    feeds = spark.createDataFrame([("hs", FEED.format(ITEM.format("x &amp;amp; y", "Wed, 31 Jan 2024 12:00:00 GMT")))], "source string, xml string")
    config = spark.createDataFrame([], schemas.CONFIG)
    taken = refresh.unique_articles(feeds, config=config, now=F.lit("2024-02-01 00:00:00").cast("timestamp"))
    assert [json.loads(r.object_json)["name"] for r in taken.collect()] == ["x & y"]
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    # from the result down: entities are decoded after the join with the markers, which only chooses rows
    assert plan.index("ArrowEvalPython") < plan.index("_since")


FEED = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>{0}</title><link>https://n/{0}</link><pubDate>{1}</pubDate></item>"


def small_store(spark, root):
    """Three objects, a log of a like, a comment and a deletion, and two feeds."""
    day = datetime(2024, 1, 28)
    stored = manifest.Store(spark, root, {name: schemas.TABLES[name] for name in ("objects", "activities", "config")})
    run = stored.begin()
    objects = [dict(id=i, source="hs", published=day - timedelta(days=n), updated=day, like_count=9, dislike_count=0, og_enriched=True, tags_enriched=i != "b",
                    object_json=json.dumps({"type": "Article", "id": i, "name": f"uutinen {i}"})) for n, i in enumerate("abc")]
    run.rewrite("objects", _objects(spark, objects), [])
    log = [("1", "Like", "a", 1), ("2", "Create", "n1", 2), ("3", "Create", "n2", 3), ("4", "Delete", "n2", 4)]
    run.rewrite("activities", tables.conform(spark.createDataFrame(
        [(i, t, "u", o, "c" if t == "Create" else None, day + timedelta(hours=h), day + timedelta(hours=h)) for i, t, o, h in log],
        "id string, type string, actor string, object_id string, thread_root string, published timestamp, received_at timestamp"), "activities"), [])
    run.replace("config", tables.conform(spark.createDataFrame([], schemas.CONFIG), "config"))
    run.commit()
    feeds = spark.createDataFrame([("hs", FEED.format(ITEM.format("x", "Wed, 31 Jan 2024 12:00:00 GMT") + ITEM.format("old", "Mon, 01 Jan 2024 12:00:00 GMT")))], "source string, xml string")
    pages = spark.createDataFrame([("https://n/x", "<title>pitempi otsikko</title>")], "url string, html string")
    return stored, dict(feeds=feeds, pages=pages, as_of=F.lit("2024-01-30").cast("date"), now=F.lit("2024-02-01 00:00:00").cast("timestamp"),
                        run_time=F.lit("2024-02-01T00:00:00Z"))


def content(stored):
    return {name: rows(stored.read(name)) for name in ("objects", "config")}


def test_a_run_is_all_or_nothing(spark, tmp_path, monkeypatch):
    """Stopped at any step, a run shows nothing; done again, it gives what an undisturbed one gives."""
    stored, inputs = small_store(spark, str(tmp_path / "calm"))
    refresh.run_refresh(stored, Recency.at(spark, str(tmp_path / "calm-recency"), 2), **inputs)
    expected = content(stored)
    made = {r["id"].rsplit("/", 1)[-1][:8]: r for r in stored.read("objects").collect()}
    assert len(made) == 4 and made["a"]["like_count"] == 1 and made["c"]["updated"] == datetime(2024, 1, 28, 2) and made["b"]["tags_enriched"]
    new = next(r for r in made.values() if r["id"] not in "abc")
    assert json.loads(new["object_json"])["name"] == "pitempi otsikko" and new["og_enriched"] and new["tags_enriched"]
    assert stored.manifest().dated["objects"]["2024-01-28"] == 1 and stored.manifest().run == 1

    stored, inputs = small_store(spark, str(tmp_path / "rough"))
    before = content(stored)
    kept = Recency.at(spark, str(tmp_path / "rough-recency"), 2)
    for owner, step in ((Recency, "advance"), (manifest.Run, "rewrite"), (manifest.Run, "replace"), (manifest.Run, "commit")):
        real = getattr(owner, step)
        for late in (False, True):
            if late and step == "commit":
                continue

            def stopped(*args, real=real, late=late):
                if late:
                    real(*args)
                raise RuntimeError("lost")

            with monkeypatch.context() as patch:
                patch.setattr(owner, step, stopped)
                with pytest.raises(RuntimeError):
                    refresh.run_refresh(stored, kept, **inputs)
            assert content(stored) == before
    refresh.run_refresh(stored, kept, **inputs)
    assert content(stored) == expected
    # again: nothing new, nothing changes, and what no manifest names can go
    refresh.run_refresh(stored, kept, **inputs)
    refresh.run_refresh(stored, kept, **inputs)
    stored.vacuum()
    assert rows(stored.read("objects")) == expected["objects"]
    assert {p.name for p in (tmp_path / "rough" / "config").iterdir()} == {"run=2", "run=3"}


def test_a_run_reads_and_writes_its_dates_only(spark, tmp_path):
    stored, inputs = small_store(spark, str(tmp_path / "s"))
    untouched = tmp_path / "s" / "objects" / "run=0" / "published_date=2024-01-26"
    refresh.run_refresh(stored, Recency.at(spark, str(tmp_path / "r"), 2), **inputs)
    refresh.run_refresh(stored, Recency.at(spark, str(tmp_path / "r"), 2), **inputs)
    assert untouched.exists()
    later = stored.manifest()
    run = stored.begin()
    assert {p.name for p in (tmp_path / "s" / "objects").iterdir()} >= {"run=0", "run=1"} and later.run == run.before.run == 2
    pruned = stored.read("objects").filter("published_date = '2024-01-26'")
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull(published_date" in pruned._jdf.queryExecution().executedPlan().toString()


def test_page_metadata_in_place_is_the_merge(spark):
    """Also where rows share an id, have none, or hold a document that cannot be read."""
    def doc(name, url):
        return json.dumps({"name": name, "url": url})

    objects = _objects(spark, [dict(og_enriched=False) | row for row in [
        dict(id="one", source="hs", object_json=doc("a", "https://n/1")), dict(id="lost", source="hs", object_json=doc("a", "https://n/9")),
        dict(id="none", source="hs", object_json="{}"), dict(id="bad", source="hs", object_json="[1"), dict(id="null", source="hs", object_json=None),
        dict(id="gone", source="hs", deleted=True, object_json=doc("a", "https://n/1")), dict(id="note", source="user", object_json=doc("a", "https://n/1")),
        dict(id="twice", source="hs", object_json=doc("b", "https://n/9")), dict(id="twice", source="hs", object_json=doc("c", "https://n/2")),
        dict(id="twice", source="user", og_enriched=True, object_json="x"), dict(id="unread", source="hs", object_json="?"), dict(id="unread", source="hs", object_json="!"),
        dict(id=None, source="hs", object_json=doc("d", "https://n/1")), dict(id=None, source="hs", object_json=doc("d", "https://n/1")),
    ]])
    pages = spark.createDataFrame(
        [("https://n/1", "a longer title", None, "https://i", None, None), ("https://n/2", "second title", "text", None, None, None), ("https://n/2", "also second", None, None, None, None)],
        "page_url string, title string, description string, image string, published_time string, modified_time string")
    in_place = enrichment.enrich_in_place(objects, pages)
    assert in_place.columns == objects.columns
    assert rows(in_place) == rows(enrichment.enrich_pages(objects, pages))
    assert {r.id: r.og_enriched for r in in_place.filter("id is not null").collect()} == {
        "one": True, "lost": True, "none": True, "bad": False, "null": False, "gone": False, "note": False, "twice": True, "unread": False}


def test_a_refresh_merges_articles_and_counters_once(spark, tmp_path):
    """One of its steps reads them; those after it go on from what that one wrote."""
    stored, inputs = small_store(spark, str(tmp_path / "s"))
    objects = stored.read("objects")
    articles = stage(refresh.unique_articles(inputs["feeds"]), "articles")
    changes = stage(objects.select("id", F.lit(1).cast("bigint").alias("like_count"), F.lit(0).cast("bigint").alias("dislike_count"), F.lit(None).cast("timestamp").alias("last_activity_at")), "changes")
    steps = []

    def keep(df):
        steps.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return stage(df)

    done = refresh.refreshed(objects, articles, extract_page_metadata(inputs["pages"]), changes, keep=keep)
    keep(done.rows)
    assert done.rows.count() == done.ids.count() == 5
    for table in (objects, articles, changes):
        folder = table.inputFiles()[0].removeprefix("file:").lstrip("/").split("/run=")[0].rsplit("/part-")[0]
        assert [folder in step for step in steps] == [True] + [False] * (len(steps) - 1)


def test_config_put_replaces_and_adds(spark):
    config = spark.createDataFrame([("a", "1", None, "x"), ("b", "2", None, "x")], "key string, value string, updated_at timestamp, updated_by string")
    put = state.config_put(config, spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string"), F.current_timestamp(), "job")
    assert {(r.key, r.value, r.updated_by) for r in put.collect()} == {("a", "1", "x"), ("b", "3", "job"), ("c", "4", "job")}


def test_document_contracts(spark):
    def doc(**fields):
        return json.dumps({k.replace("at_", "@"): v for k, v in fields.items()})

    full = dict(at_context="c", type="Note", id="i", content="x", published="p", attributedTo="u", inReplyTo="a")
    objects = spark.createDataFrame([
        ("ok", doc(**full)), ("short", doc(**{k: v for k, v in full.items() if k not in ("content", "inReplyTo")})),
        ("list", "[1]"), ("none", None), ("odd", doc(type="Event")), ("untyped", doc(id="x")),
        ("tag", doc(type="Hashtag")), ("page", doc(at_context="c", type="OrderedCollection", id="i", totalItems=0, orderedItems=[])),
    ], "id string, object_json string")
    got = {r.id: (r.problem, r.missing) for r in quality.validate_documents(objects).collect()}
    assert got == {
        "short": ("missing keys", ["content", "inReplyTo"]), "list": ("not a JSON object", None), "none": ("no document", None),
        "odd": ("unknown type", None), "untyped": ("no type", None), "tag": ("missing keys", ["name"]),
    }


def test_stage_uses_the_configured_folder(spark, shared_folder):
    before = set(shared_folder.glob("stage-*"))
    assert stage(configure(spark).range(5)).count() == 5
    assert len(set(shared_folder.glob("stage-*")) - before) == 1
