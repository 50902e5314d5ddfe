"""The scheduled jobs in their order: ingest, page metadata, tags, counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.urls import BASE
from newsloom.operators.enrichment import enrich_in_place
from newsloom.operators.merge import latest_per_key
from newsloom.operators.objects import apply_tags, upsert_articles
from newsloom.operators.reactions import apply_counter_changes, counter_changes, last_activity, reaction_counts
from newsloom.operators.recency import Recency
from newsloom.operators.state import advanced_markers, config_put, new_since
from newsloom.operators.tagging import tag_objects
from newsloom.session import stage
from newsloom.sources.feeds import cleaned_items, dated_items, feed_articles
from newsloom.sources.manifest import Store
from newsloom.sources.pages import extract_page_metadata
from newsloom.sources.tables import with_published_date

Stage = Callable[[DataFrame], DataFrame]


def ingest(
    objects: DataFrame, feeds: DataFrame, base: str = BASE, config: DataFrame | None = None, now: Column | None = None,
    keep: Stage = stage,
) -> DataFrame:
    """Objects with the articles of feed documents (source, xml) merged in.

    With ``config`` and ``now`` only items newer than their source's last successful fetch are taken.
    """
    return upsert_articles(objects, keep(unique_articles(feeds, base, config, now)))


@dataclass
class Refreshed:
    """What a refresh changes: the rows that replace and the new ones, and the ids and publication times (id, published) they go by."""

    rows: DataFrame
    ids: DataFrame


def refreshed(
    objects: DataFrame, articles: DataFrame, metadata: DataFrame, changes: DataFrame, lexicon: DataFrame | None = None,
    keep: Stage = stage,
) -> Refreshed:
    """All jobs on the objects they can change, and on no others.

    These are the rows with an article or a counter change of their own, and rows that wait for page metadata or tags. They
    are picked in one pass over the objects, in which articles and counters are merged in, and written out once; neither page
    metadata nor tags depend on what the counters' job writes. ``articles`` and ``changes`` (see counter_changes) have unique
    ids and are written out. ``rows`` is not: it is for one use.
    """
    named = articles.select("id").union(changes.select("id")).distinct().withColumn("_named", F.lit(True))
    waiting = ~F.col("deleted") & (~F.col("og_enriched") | ~F.col("tags_enriched"))
    columns = [c for c in objects.columns if c != "published_date"]
    chosen = objects.join(named, "id", "left").filter(F.coalesce(F.col("_named"), F.lit(False)) | waiting).select(*columns)
    merged = keep(apply_counter_changes(upsert_articles(chosen, articles), changes))
    with_pages = enrich_in_place(merged, metadata, keep)
    rows = apply_tags(with_pages, keep(tag_objects(with_pages, lexicon)))
    return Refreshed(rows, merged.select("id", "published"))


def unique_articles(feeds: DataFrame, base: str = BASE, config: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Rows for upsert_articles from feed documents (source, xml), one per id.

    With ``config`` and ``now`` only items newer than their source's last successful fetch are taken.
    """
    items = dated_items(feeds)
    if config is not None:
        items = new_since(items, config, now)
    return latest_per_key(feed_articles(cleaned_items(items), base), "id", [F.desc("updated"), F.desc("object_json")])


def refresh(
    objects: DataFrame,
    *,
    feeds: DataFrame,
    pages: DataFrame,
    activities: DataFrame,
    as_of: Column,
    lexicon: DataFrame | None = None,
    base: str = BASE,
    config: DataFrame | None = None,
    now: Column | None = None,
    keep: Stage = stage,
) -> DataFrame:
    """Objects after all jobs, one after the other. Only small results are written out (``keep``), never the table."""
    articles = keep(unique_articles(feeds, base, config, now))
    changes = keep(counter_changes(reaction_counts(activities, as_of), last_activity(activities)))
    done = refreshed(objects, articles, extract_page_metadata(pages), changes, lexicon, keep)
    return objects.join(done.ids, "id", "left_anti").unionByName(done.rows.select(*objects.columns))


RECENCY_KEY = "counters.received_at"


def run_refresh(
    store: Store, recency: Recency, *, feeds: DataFrame, pages: DataFrame, as_of: Column, now: Column, run_time: Column,
    lexicon: DataFrame | None = None, base: str = BASE, keep: Stage = stage,
) -> None:
    """All jobs on the stored tables (objects, activities, config) as one run.

    Feed items and log rows are taken from where the last committed run got to. The objects' changed dates, the fetch markers of
    the feeds' sources and the place in the log are committed together, so a run that stops at any step has changed nothing
    that is read, and is done again. ``recency`` may have been advanced by then; taking rows in twice does no harm.
    """
    run = store.begin()
    objects, activities, config = run.read("objects"), run.read("activities"), run.read("config")
    articles = keep(unique_articles(feeds, base, config, now))
    since = config.filter(F.col("key") == RECENCY_KEY).select(F.max(F.try_to_timestamp("value"))).first()[0]
    new = activities if since is None else activities.filter(F.col("received_at") >= F.lit(since))
    last = keep(recency.advance(new).filter("last_activity_at is not null"))
    changes = keep(counter_changes(reaction_counts(activities, as_of), last))
    done = refreshed(objects, articles, extract_page_metadata(pages), changes, lexicon, keep)
    rows = with_published_date(done.rows)
    # a row per date: as many as the table has folders at most
    old = objects.select("id", "published_date").join(done.ids, "id", "left_semi").select("published_date")
    dates = [r[0] for r in old.union(with_published_date(done.ids).select("published_date")).distinct().collect()]
    others = objects.filter(F.col("published_date").isin(dates)).join(done.ids, "id", "left_anti")
    run.rewrite("objects", others.unionByName(rows.select(*others.columns)), dates)
    moved = advanced_markers(config, feeds, run_time, now, "feeds")
    top = new.agg(F.max("received_at").cast("timestamp").alias("top")).filter("top is not null")
    place = top.select(F.lit(RECENCY_KEY).alias("key"), F.date_format("top", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("value"))
    run.replace("config", config_put(moved, place, now, "counters"))
    run.commit()


def fetched(config: DataFrame, feeds: DataFrame, run_time: Column, now: Column) -> DataFrame:
    """Config with the fetch markers of the feeds' sources moved to the run time (after a successful write)."""
    return advanced_markers(config, feeds, run_time, now, "feeds")
