"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame.

Results are flat (arrays joined, documents split into fields) so that an independent SQL engine can
state the same result; see oracles.py.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom import schemas
from newsloom.functions import documents as docs, text as tx, times, urls
from newsloom.operators import activities as act, enrichment, objects as ob, postings, quality, reactions, recency, replay, search, state, tagging, threads, variants
from newsloom.operators.merge import latest_per_key
from newsloom.plans import refresh, views
from newsloom.session import configure, packed, shared_folder, stage
from newsloom.sources import feeds, manifest, pages, tables
from newsloom.streaming import jobs

SEARCH = ["the", "les", "der"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def _ntz(column: str | Column) -> Column:
    """UTC wall-clock time, the type the SQL check uses."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp_ntz")


def _joined(column: str) -> Column:
    return F.array_join(column, ",")


def _field(name: str, column: str = "object_json") -> Column:
    return docs.text_field(F.col(column), name)


# ---- search ----------------------------------------------------------------------------------------


@query
def outbox_top_n(spark, sf_dir):
    return search.outbox(views.objects(spark, sf_dir, tags=True), SEARCH)


@query
def outbox_total(spark, sf_dir):
    return search.total_items(views.objects(spark, sf_dir, tags=True), SEARCH)


@query
def outbox_items_flat(spark, sf_dir):
    items = search.outbox_items(views.objects(spark, sf_dir, tags=True), SEARCH)
    return items.select(
        "id", "relevance", _field("likes", "document").cast("bigint").alias("likes"),
        _field("updated", "document").alias("updated_text"), _field("name", "document").alias("name"),
    )


@query
def outbox_collection(spark, sf_dir):
    """The collection document, taken apart again."""
    known = views.objects(spark, sf_dir, tags=True)
    document = search.outbox_document(search.outbox_items(known, SEARCH), search.total_items(known, SEARCH), SEARCH)
    listed = F.from_json(_field("orderedItems", "document"), "array<struct<id:string,likes:bigint,updated:string>>")
    return document.select(_field("totalItems", "document").cast("bigint").alias("total_items"), F.posexplode(listed).alias("place", "item")).select(
        "total_items", "place", "item.id", "item.likes", F.col("item.updated").alias("updated_text"))


@query
def outbox_many(spark, sf_dir):
    return search.outbox_many(views.objects(spark, sf_dir, tags=True), views.searches(spark, sf_dir))


@query
def outbox_postings(spark, sf_dir):
    """outbox_many over postings in blocks."""
    index = postings.build_postings(views.objects(spark, sf_dir, tags=True))
    return postings.search_postings(index, views.searches(spark, sf_dir))


@query
def search_urls(spark, sf_dir):
    wanted = search.normalised_searches(views.searches(spark, sf_dir))
    return wanted.select("search_id", search.search_url(F.col("tags"), F.col("n")).alias("url"))


@query
def search_status(spark, sf_dir):
    return search.checked_searches(views.searches(spark, sf_dir)).select("search_id", F.size("tags").alias("n_tags"), "n", "status", "reason")


@query
def relevance_dup(spark, sf_dir):
    wanted = F.array(*[F.lit(tag) for tag in SEARCH])
    doubled = F.concat(F.col("tags"), F.slice("tags", 1, 1))
    return views.object_tags(spark, sf_dir).select("id", search.relevance(doubled, wanted).alias("relevance"))


@query
def live_objects(spark, sf_dir):
    return ob.live(views.objects(spark, sf_dir)).select("id", "source", "like_count")


# ---- tagging ---------------------------------------------------------------------------------------


@query
def object_texts(spark, sf_dir):
    return tagging.object_texts(views.board(spark, sf_dir))


@query
def tags_top16(spark, sf_dir):
    return tagging.ranked_tags(tagging.lemmas(views.texts(spark, sf_dir)))


@query
def tags_lexicon(spark, sf_dir):
    counts = tagging.lemmas(views.texts(spark, sf_dir), views.lexicon(spark, sf_dir))
    return tagging.ranked_tags(counts)


@query
def pending_tags(spark, sf_dir):
    return tagging.pending_tags(views.objects(spark, sf_dir)).select("id")


@query
def pending_tags_batch(spark, sf_dir):
    return tagging.pending_tags(views.objects(spark, sf_dir), batch=200).select("id")


@query
def apply_tags(spark, sf_dir):
    tagged = tagging.enrich_tags(views.objects(spark, sf_dir))
    return tagged.select("id", _joined("tags").alias("tags"), "tags_enriched")


@query
def likes_tag(spark, sf_dir):
    return tagging.with_likes_tag(views.objects(spark, sf_dir, tags=True)).select("id", _joined("tags").alias("tags"))


# ---- counters --------------------------------------------------------------------------------------


@query
def window_filter(spark, sf_dir):
    return ob.in_window(views.activities(spark, sf_dir), views.as_of()).select("id", "published")


@query
def reaction_counts(spark, sf_dir):
    return reactions.reaction_counts(views.activities(spark, sf_dir), views.as_of())


@query
def reaction_counts_current(spark, sf_dir):
    return reactions.reaction_counts_current(views.likes(spark, sf_dir))


@query
def apply_reaction_counts(spark, sf_dir):
    counts = reactions.reaction_counts(views.activities(spark, sf_dir), views.as_of())
    return reactions.apply_reaction_counts(views.objects(spark, sf_dir), counts).select("id", "like_count", "dislike_count")


@query
def without_deleted(spark, sf_dir):
    return reactions.without_deleted(views.activities(spark, sf_dir)).select("id", "type", "object_id")


@query
def last_activity(spark, sf_dir):
    return reactions.last_activity(views.activities(spark, sf_dir))


@query
def apply_last_activity(spark, sf_dir):
    last = reactions.last_activity(views.activities(spark, sf_dir))
    return reactions.apply_last_activity(views.objects(spark, sf_dir), last).select("id", "updated")


@query
def refresh_counters(spark, sf_dir):
    refreshed = reactions.refresh_counters(views.objects(spark, sf_dir), views.activities(spark, sf_dir), views.as_of())
    return refreshed.select("id", "like_count", "dislike_count", "updated")


@query
def actor_object_counts(spark, sf_dir):
    return reactions.actor_object_counts(views.activities(spark, sf_dir))


@query
def actor_stats(spark, sf_dir):
    return reactions.actor_stats(views.activities(spark, sf_dir))


@query
def recency_incremental(spark, sf_dir):
    """The log taken in by ten-day pieces, the middle one twice; deletions take back what earlier pieces brought."""
    log = views.activities(spark, sf_dir)
    kept = recency.Recency.at(spark, f"{shared_folder(spark)}/recency-{uuid.uuid4().hex}", buckets=4)
    for first, last in ((1, 10), (11, 20), (11, 20), (21, 31)):
        kept.advance(log.filter(F.dayofmonth("received_at").between(first, last)))
    return kept.last_activity().withColumn("last_activity_at", _ntz("last_activity_at"))


@query
def streamed_counters(spark, sf_dir):
    """The log as a stream of daily panes, then the window moved twice over the stored objects."""
    folder = f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}"
    tables.write_table(views.objects(spark, sf_dir), folder, "objects")
    jobs.stream_reaction_counts(views.activities(spark, sf_dir, stream=True), f"{folder}/panes", f"{folder}/mark").awaitTermination()
    for day in (date(2024, 1, 20), date(2024, 1, 30)):
        jobs.slide_counters(spark, folder, f"{folder}/panes", day)
    return tables.read_table(spark, folder, "objects").select("id", "like_count", "dislike_count")


@query
def streamed_reaction_state(spark, sf_dir):
    """The reactions of the log as a stream with a state per actor and object."""
    folder = f"{shared_folder(spark)}/reactions-{uuid.uuid4().hex}"
    attempts = views.activities(spark, sf_dir, stream=True).filter("type in ('Like', 'Dislike')").select(
        F.col("id").alias("request_id"), F.col("id").alias("activity_id"), "type", "actor", F.col("object_id").alias("target_id"), "received_at")
    jobs.stream_reaction_state(attempts, f"{folder}/state", f"{folder}/mark").awaitTermination()
    state_now = jobs.current_reactions(spark, f"{folder}/state")
    return state_now.select("actor", "object_id", "activity_id", "reaction_type", _ntz("published").alias("published"))


# ---- merges ----------------------------------------------------------------------------------------


@query
def latest_per_key_rows(spark, sf_dir):
    log = views.activities(spark, sf_dir).select("id", "type", "actor", "object_id", "received_at")
    return latest_per_key(log, ["actor", "object_id"], [F.desc("received_at"), F.asc("id")])


@query
def upsert_articles(spark, sf_dir):
    merged = ob.upsert_articles(views.objects(spark, sf_dir), views.edits(spark, sf_dir))
    return merged.select(
        "id", "source", "published", "updated", "like_count", "dislike_count", "tags_enriched", "og_enriched", "deleted",
        _field("name").alias("name"),
    )


@query
def rewrite_touched(spark, sf_dir):
    """The article upsert on a stored table, of which only the touched dates are read and written."""
    root = f"{shared_folder(spark)}/merge-{uuid.uuid4().hex}"
    tables.write_table(views.objects(spark, sf_dir), root, "objects")
    tables.rewrite_touched(spark, root, "objects", views.edits(spark, sf_dir), ob.upsert_articles)
    return tables.read_table(spark, root, "objects").select(
        "id", "source", "published", "updated", "like_count", "dislike_count", "tags_enriched", "og_enriched", "deleted",
        _field("name").alias("name"),
    )


@query
def appended_log(spark, sf_dir):
    """The log appended in two parts, read back by its partition column."""
    root = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log = views.activities(spark, sf_dir)
    for odd in (0, 1):
        tables.append_activities(log.filter(F.pmod(F.length("id"), F.lit(2)) == odd), root)
    return tables.read_table(spark, root, "activities").select("id", "type", "actor", "object_id", "published_date")


@query
def streamed_articles(spark, sf_dir):
    """The article upsert with the versions collected by a stream."""
    folder = f"{shared_folder(spark)}/articles-{uuid.uuid4().hex}"
    jobs.stream_upsert_articles(views.edits(spark, sf_dir, stream=True), f"{folder}/versions", f"{folder}/mark").awaitTermination()
    merged = jobs.compacted_articles(views.objects(spark, sf_dir), f"{folder}/versions")
    return merged.select(
        "id", "source", "published", "updated", "like_count", "dislike_count", "tags_enriched", "og_enriched", "deleted",
        _field("name").alias("name"))


@query
def upsert_scraped(spark, sf_dir):
    scraped = stage(enrichment.scraped_articles(_page_metadata(spark, sf_dir), views.now()))
    merged = ob.upsert_scraped(views.scraped_targets(spark, sf_dir), scraped)
    return merged.select("id", "source", "published", "updated", "og_enriched", "like_count", "deleted", _field("name").alias("name"))


@query
def upsert_notes(spark, sf_dir):
    merged = ob.upsert_notes(views.board(spark, sf_dir), views.note_versions(spark, sf_dir), views.now())
    return merged.select("id", "source", "published", "updated", "like_count", "deleted", _field("content").alias("content"))


@query
def apply_updates(spark, sf_dir):
    versions = views.note_versions(spark, sf_dir).select("id", "object_json")
    merged = ob.apply_updates(views.board(spark, sf_dir), versions, views.now())
    return merged.select("id", "updated", _field("content").alias("content"))


@query
def soft_delete(spark, sf_dir):
    disliked = views.activities(spark, sf_dir).filter("type = 'Dislike'").select(F.col("object_id").alias("id")).distinct()
    return ob.soft_delete(views.objects(spark, sf_dir), disliked, views.now()).select("id", "deleted", "updated")


@query
def lookup_objects(spark, sf_dir):
    ids = views.activities(spark, sf_dir).select(F.col("object_id").alias("id")).distinct()
    found = ob.lookup_objects(ids, views.objects(spark, sf_dir))
    return found.select("id", "source", "deleted", "like_count", "dislike_count", _field("name").alias("name"))


@query
def migrate_objects(spark, sf_dir):
    old = views.objects(spark, sf_dir).drop("dislike_count", "og_enriched_error").withColumn(
        "og_enriched", F.when(F.col("og_enriched"), F.lit(True))
    )
    return ob.migrate_objects(old).select("id", "dislike_count", "og_enriched", "og_enriched_error")


@query
def touched_dates(spark, sf_dir):
    target = tables.with_published_date(views.objects(spark, sf_dir))
    return tables.touched_dates(target, views.edits(spark, sf_dir))


@query
def null_violations(spark, sf_dir):
    return tables.null_violations(views.edits(spark, sf_dir).withColumn("updated", F.col("published")).withColumn(
        "source", F.when(F.col("source") != "src3-feed", F.col("source"))), "objects")


# ---- feeds -----------------------------------------------------------------------------------------


@query
def feed_items(spark, sf_dir):
    items = feeds.parse_feeds(views.feed_xml(spark, sf_dir))
    return items.select("source", "title", "link", "summary", _ntz("published").alias("published"))


@query
def undated_items(spark, sf_dir):
    return feeds.undated_items(views.feed_xml(spark, sf_dir)).select("source", "link", "title")


@query
def rejected_items(spark, sf_dir):
    return feeds.rejected_items(views.feed_xml(spark, sf_dir)).select("source", "link", "title", "reason")


@query
def rejected_feeds(spark, sf_dir):
    return feeds.rejected_feeds(views.cut_feeds(spark, sf_dir)).groupBy("source", "reason").agg(F.count("*").alias("n"))


@query
def recovered_items(spark, sf_dir):
    """Items of feeds that are cut off in their last one."""
    items = feeds.parse_feeds(views.cut_feeds(spark, sf_dir))
    return items.select("source", "title", "link", "summary", _ntz("published").alias("published"), "image_url")


@query
def damaged_items(spark, sf_dir):
    lost = feeds.damaged_items(views.cut_feeds(spark, sf_dir))
    return lost.select("source", "reason", F.nullif(F.regexp_extract("fragment", "news.example/([0-9]+)", 1), F.lit("")).cast("bigint").alias("doc_id"))


@query
def feed_images(spark, sf_dir):
    return feeds.parse_feeds(views.feed_xml(spark, sf_dir)).select("link", "image_url")


@query
def feed_pubdates(spark, sf_dir):
    """Mail-style dates in several spellings, parsed and printed back."""
    number = F.col("event_id")
    text = (
        F.when(number % 6 == 0, F.date_format("ts", "E, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(number % 6 == 1, F.date_format("ts", "d MMM yyyy HH:mm:ss '+0130'"))
        .when(number % 6 == 2, F.date_format("ts", "EEEE, dd MMM yy HH:mm:ss 'EST'"))
        .when(number % 6 == 3, F.date_format("ts", "E, d MMM yyyy HH:mm '-0200'"))
        .when(number % 6 == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.concat(F.lit("day "), number.cast("string")))
    )
    dated = views.table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return dated.select(
        "event_id",
        _ntz(times.parse_rfc2822(F.col("text"))).alias("mail_date"),
        _ntz(times.parse_any(F.col("text"))).alias("any_date"),
        times.rfc3339(times.parse_any(F.col("text"))).alias("printed"),
    )


@query
def feed_articles(spark, sf_dir):
    made = feeds.feed_articles(feeds.parse_feeds(views.feed_xml(spark, sf_dir)))
    return made.select(
        "id", "source", _ntz("published").alias("published"), _field("name").alias("name"), _field("url").alias("url"),
        _field("published").alias("published_text"), docs.text_field(F.col("object_json"), "attributedTo", "name").alias("publisher"),
        docs.text_field(F.col("object_json"), "image", "url").alias("image_url"),
    )


@query
def article_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(
        "page_id", urls.article_id(F.lit("hs"), F.col("url")).alias("article_id"), urls.scraped_id(F.col("url")).alias("scraped_id")
    )


@query
def publisher_dim(spark, sf_dir):
    sources = views.feed_xml(spark, sf_dir).select("source").distinct()
    return feeds.with_publisher(sources)


@query
def atom_dates(spark, sf_dir):
    """Feeds whose items have an atom:updated in place of their date."""
    xml = F.replace(F.replace("xml", F.lit("<pubDate>"), F.lit("<atom:updated>")), F.lit("</pubDate>"), F.lit("</atom:updated>"))
    items = feeds.parse_feeds(views.feed_xml(spark, sf_dir).withColumn("xml", xml), atom_dates=True)
    return items.select("source", "link", _ntz("published").alias("published"), _ntz("updated").alias("updated"))


@query
def feed_list(spark, sf_dir):
    """Feed lists per language: a feed per source, entries without a name or an address left out."""
    sources = views.table(spark, sf_dir, "documents").groupBy("lang", "source").agg((F.max("doc_id") % 4).alias("kind"))
    entry = F.to_json(F.struct(
        F.when(F.col("kind") == 1, "").otherwise(F.col("source")).alias("name"),
        F.when(F.col("kind") != 2, F.concat(F.lit("https://"), F.col("source"), F.lit(".example/rss"))).alias("url"),
        F.when(F.col("kind") == 3, F.lit(True)).alias("autodiscover")))
    lists = sources.groupBy("lang").agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("feeds"))
    return feeds.load_feeds(lists).groupBy("name", "url", "autodiscover").agg(F.count("*").alias("n"))


# ---- pages -----------------------------------------------------------------------------------------


def _page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_page_metadata(views.og_pages(spark, sf_dir))


@query
def page_titles(spark, sf_dir):
    metadata = pages.extract_page_metadata(views.table(spark, sf_dir, "pages"))
    return metadata.select("page_id", "title", "url", "description")


@query
def page_metadata(spark, sf_dir):
    return _page_metadata(spark, sf_dir)


@query
def feed_links(spark, sf_dir):
    return pages.discover_feed_links(views.og_pages(spark, sf_dir))


@query
def absolute_url(spark, sf_dir):
    """Every link of every page, joined to the page's address."""
    href = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    links = views.table(spark, sf_dir, "pages").select("page_id", "url", href.alias("href"))
    joined = urls.absolute_url(F.col("href"), F.col("url"))
    return links.groupBy("page_id", joined.alias("link")).agg(F.count("*").alias("n"))


@query
def url_parts(spark, sf_dir):
    url = F.col("url")
    return views.table(spark, sf_dir, "pages").select(
        "page_id", urls.authority(url).alias("authority"), urls.site(url).alias("site"), urls.is_http_url(url).alias("is_http")
    )


@query
def scraped_articles(spark, sf_dir):
    made = enrichment.scraped_articles(_page_metadata(spark, sf_dir), views.now())
    return made.select(
        "id", _ntz("published").alias("published"), _ntz("updated").alias("updated"), _field("name").alias("name"),
        _field("summary").alias("summary"), _field("url").alias("url"), _field("published").alias("published_text"),
        docs.text_field(F.col("object_json"), "attributedTo", "name").alias("author"),
        docs.text_field(F.col("object_json"), "image", "url").alias("image_url"),
    )


@query
def iso_fallback(spark, sf_dir):
    read = _page_metadata(spark, sf_dir)
    return read.select("page_url", _ntz(F.coalesce(times.parse_iso(F.col("published_time")), views.now().cast("timestamp"))).alias("published"))


@query
def pending_og(spark, sf_dir):
    return ob.pending_og(views.objects(spark, sf_dir)).select("id", _field("url").alias("url"))


@query
def pending_og_batch(spark, sf_dir):
    return ob.pending_og(views.objects(spark, sf_dir), batch=100).select("id", _field("url").alias("url"))


def _og_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata under the addresses the articles carry; pages of every 19th document are missing."""
    read = _page_metadata(spark, sf_dir)
    number = F.regexp_extract("page_url", r"(\d+)$", 1).cast("bigint")
    return read.withColumn("page_url", F.when(number % 19 != 0, F.col("page_url")).otherwise(F.lit("https://gone.example/")))


@query
def apply_og(spark, sf_dir):
    merged = enrichment.enrich_pages(views.objects(spark, sf_dir), _og_by_article(spark, sf_dir))
    return merged.select(
        "id", "og_enriched", "og_enriched_error", _field("name").alias("name"), _field("summary").alias("summary"),
        docs.text_field(F.col("object_json"), "image", "url").alias("image_url"), _field("published").alias("published_text"),
        _field("updated").alias("updated_text"), "updated",
    )


@query
def unreadable_documents(spark, sf_dir):
    """Documents cut in the middle wait on; all others are marked as processed."""
    number = F.regexp_extract("id", r"\d+", 0).cast("bigint")
    broken = F.when(number % 7 == 0, F.expr("substring(object_json, 1, length(object_json) - 1)")).otherwise(F.col("object_json"))
    cut = views.objects(spark, sf_dir).withColumn("object_json", broken)
    return enrichment.enrich_pages(cut, _og_by_article(spark, sf_dir)).select("id", "og_enriched", "og_enriched_error")


@query
def og_field_merge(spark, sf_dir):
    """The field rules on every page against a document with the page's own number as name."""
    page = {name: F.col(name) for name in ["title", "description", "image", "published_time", "modified_time"]}
    document = F.to_json(F.struct(F.concat(F.lit("  "), F.col("page_url"), F.lit("\t")).alias("name")))
    fields = enrichment.merged_fields(document, page)
    return _page_metadata(spark, sf_dir).select(
        "page_url", fields["name"].alias("name"), fields["summary"].alias("summary"), fields["image"]["url"].alias("image_url"),
        fields["published"].alias("published_text"), fields["updated"].alias("updated_text"),
    )


@query
def refresh_pipeline(spark, sf_dir):
    """All jobs as one committed run over stored tables: new feed items, page metadata, tags, counters, recency, markers."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    stored = manifest.Store(spark, root, {name: schemas.TABLES[name] for name in ("objects", "activities", "config")})
    first = stored.begin()
    for name, rows in (("objects", views.objects(spark, sf_dir)), ("activities", views.activities(spark, sf_dir))):
        first.rewrite(name, tables.conform(rows, name), [])
    first.replace("config", tables.conform(views.config_seed(spark, sf_dir), "config"))
    first.commit()
    refresh.run_refresh(
        stored, recency.Recency.at(spark, f"{root}/recency", buckets=4), feeds=views.feed_xml(spark, sf_dir),
        pages=views.og_pages(spark, sf_dir), as_of=views.as_of(), now=views.now(), run_time=F.lit("2024-02-01T00:00:00Z"))
    return stored.read("objects").select(
        "id", "source", _field("name").alias("name"), "og_enriched", "og_enriched_error", "tags_enriched", "like_count", "dislike_count",
        _ntz("updated").alias("updated"))


# ---- text ------------------------------------------------------------------------------------------


@query
def longer(spark, sf_dir):
    """Each document's text against the next lower document's, both padded."""
    left = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" \n"), F.col("text")).alias("a"))
    right = views.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("doc_id"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text")).alias("b")
    )
    return left.join(right, "doc_id", "left").select("doc_id", tx.longer(F.col("a"), F.col("b")).alias("text"))


@query
def clean_text(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


@query
def clean_text_tagging(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", tx.clean_text(F.col("html"), collapse=False).alias("text"))


# ---- requests --------------------------------------------------------------------------------------


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as apply_activities keeps them: what follows reads them more than once."""
    return packed(act.decide(views.requests(spark, sf_dir), views.board(spark, sf_dir), views.likes(spark, sf_dir)))


@query
def thread_resolution(spark, sf_dir):
    resolved = threads.resolve_threads(views.replies(spark, sf_dir), views.board(spark, sf_dir))
    return resolved.select("request_id", "in_reply_to", "status", "reason", "thread_root", "depth")


@query
def activity_dispatch(spark, sf_dir):
    checked = act.dispatch(views.requests(spark, sf_dir))
    return checked.select("request_id", "type", "target_id", "in_reply_to", F.col("malformed").alias("reason"))


@query
def activity_decisions(spark, sf_dir):
    decided = act.decide(views.requests(spark, sf_dir), views.board(spark, sf_dir), views.likes(spark, sf_dir))
    return decided.select("request_id", "type", "status", "reason", "thread_root")


@query
def classify_reactions(spark, sf_dir):
    decided = act.classify_reactions(views.requests(spark, sf_dir), views.board(spark, sf_dir), views.likes(spark, sf_dir))
    return decided.select("request_id", "status", "reason", "previous")


@query
def classify_creates(spark, sf_dir):
    decided = act.classify_creates(views.requests(spark, sf_dir), views.board(spark, sf_dir))
    return decided.select("request_id", "status", "reason", "result_id", "thread_root")


@query
def classify_deletes(spark, sf_dir):
    decided = act.classify_deletes(views.requests(spark, sf_dir), views.board(spark, sf_dir))
    return decided.select("request_id", "status", "reason", "target_id")


@query
def classify_updates(spark, sf_dir):
    decided = act.classify_updates(views.requests(spark, sf_dir), views.board(spark, sf_dir))
    return decided.select("request_id", "status", "reason", "target_id")


@query
def reaction_state(spark, sf_dir):
    state_after = act.reaction_state(_decided(spark, sf_dir), views.likes(spark, sf_dir))
    return state_after.select("actor", "object_id", "activity_id", "reaction_type", "published")


@query
def replayed_requests(spark, sf_dir):
    """A batch, then the opposite of every reaction it left, then the batch again: the second one's state stays, and no id
    is logged twice (``n_twice`` counts the rows the three deliveries logged for the pair, less their distinct ids)."""
    index = replay.RequestIndex.at(spark, f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}", buckets=4, blocks=64)
    batch = views.requests(spark, sf_dir)
    first, _ = replay.apply_once(batch, views.board(spark, sf_dir), views.likes(spark, sf_dir), index)
    index.add(first.decided)
    objects, likes = packed(first.objects.select("id", "deleted", "object_json")), packed(first.likes)
    opposite = likes.select(
        F.concat(F.lit("o/"), "actor", F.lit("/"), "object_id").alias("request_id"),
        F.when(F.col("reaction_type") == "Like", "Dislike").otherwise("Like").alias("type"), "actor", "object_id",
        F.lit(None).cast("string").alias("object_json"), F.expr("timestamp_ntz'2024-03-01 00:00:00'").alias("received_at"))
    logs = [first.activities]
    for delivery in (opposite, batch):
        done = replay.decide_once(delivery, objects, likes, index)
        index.add(done.decided)
        likes = packed(act.reaction_state(done.decided, likes))
        logs.append(act.activity_rows(done.decided))
    logged = logs[0].unionByName(logs[1]).unionByName(logs[2]).filter("type in ('Like', 'Dislike')")
    twice = logged.groupBy("actor", "object_id").agg((F.count("*") - F.countDistinct("id")).alias("n_twice"))
    return likes.join(twice, ["actor", "object_id"], "left").select(
        "actor", "object_id", "reaction_type", "published", F.coalesce("n_twice", F.lit(0).cast("long")).alias("n_twice"))


@query
def remove_reactions(spark, sf_dir):
    removals = views.activities(spark, sf_dir).filter("type = 'Update'").select("actor", "object_id")
    return act.remove_reactions(views.likes(spark, sf_dir), removals).select("actor", "object_id", "activity_id", "reaction_type")


@query
def activity_rows(spark, sf_dir):
    rows = act.activity_rows(_decided(spark, sf_dir))
    return rows.select(
        "id", "type", "actor", "object_id", "object_type", "in_reply_to", "thread_root", "received_at",
        _field("type").alias("document_type"), _field("actor").alias("document_actor"), _field("published").alias("published_text"),
    )


@query
def board_after_requests(spark, sf_dir):
    after = act.apply_activities(views.requests(spark, sf_dir), views.board(spark, sf_dir), views.likes(spark, sf_dir)).objects
    return after.select("id", "source", "deleted", "updated", _field("name").alias("name"), _field("content").alias("content"))


# ---- state and quality -----------------------------------------------------------------------------


@query
def config_put(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("top")).select(
        state.last_fetched_key(F.col("source")).alias("key"), F.concat(F.lit("v"), F.col("top").cast("string")).alias("value")
    )
    return state.config_put(views.config_seed(spark, sf_dir), rows, views.now(), "feeds")


@query
def config_get(spark, sf_dir):
    keys = views.table(spark, sf_dir, "documents").select(state.last_fetched_key(F.col("source")).alias("key")).distinct()
    return state.config_get(views.config_seed(spark, sf_dir), keys, F.lit("never"))


@query
def new_since(spark, sf_dir):
    fresh = state.new_since(views.objects(spark, sf_dir), views.config_seed(spark, sf_dir), F.expr("timestamp_ntz'2024-01-04 00:00:00'"))
    return fresh.select("id", "source", "published")


@query
def resolved_feeds(spark, sf_dir):
    """Every page as an autodiscovered feed of its own name."""
    found = pages.discover_feed_links(views.og_pages(spark, sf_dir))
    wanted = views.og_pages(spark, sf_dir).select(
        F.regexp_extract("url", "//(src[0-9]+[.]example/doc/[0-9]+)$", 1).alias("name"), "url", F.lit(True).alias("autodiscover")
    )
    return state.resolved_feeds(wanted, views.config_seed(spark, sf_dir), found)


@query
def validate_documents(spark, sf_dir):
    problems = quality.validate_documents(views.board(spark, sf_dir))
    return problems.select("id", "kind", "problem", _joined("missing").alias("missing"))


# ---- around the core -------------------------------------------------------------------------------


@query
def anonymised(spark, sf_dir):
    log = views.activities(spark, sf_dir).select("id", "type", "actor")
    return variants.anonymised(log, log.filter("type = 'Delete'"), salt="pepper")


@query
def without_actor_data(spark, sf_dir):
    log = views.activities(spark, sf_dir).select("id", "type", "actor", "object_id")
    return variants.without_actor_data(log, log.filter("type = 'Delete' and object_id like '%7'"))


@query
def state_from_log(spark, sf_dir):
    return variants.state_from_log(views.activities(spark, sf_dir))


@query
def state_from_snapshot(spark, sf_dir):
    """state_from_log from a snapshot of a snapshot, and the rest of the log."""
    log = views.activities(spark, sf_dir)
    kept = variants.StateSnapshots(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    for moment in (datetime(2024, 1, 10), datetime(2024, 1, 22)):
        kept.take(log, moment)
    return kept.current(log)


@query
def anonymised_documents(spark, sf_dir):
    """Authors with an even number leave the threads; their ids stand escaped in every third document."""
    shown = views.notes(spark, sf_dir).withColumn("object_json", F.when(
        F.pmod(F.length("id"), F.lit(3)) == 0, F.replace("object_json", F.lit("/"), F.lit("\\/"))).otherwise(F.col("object_json")))
    author = _field("attributedTo")
    leaving = views.notes(spark, sf_dir).select(author.alias("actor")).filter("actor rlike '^users/[0-9]*[02468]$'")
    hidden = variants.anonymised(shown.select("id", "object_json"), leaving, salt="pepper")
    return hidden.select("id", author.alias("author"), _field("content").alias("content"), _field("inReplyTo").alias("in_reply_to"))


@query
def expired_pending(spark, sf_dir):
    """What dated_pending leaves out."""
    waiting, metadata = _waiting(spark, sf_dir)
    return variants.expired_pending(waiting, metadata, F.expr("timestamp_ntz'2024-01-12 00:00:00'")).select("link", "reason")


@query
def placeholders(spark, sf_dir):
    shown = variants.with_placeholders(views.board(spark, sf_dir))
    return shown.select("id", "deleted", _field("content").alias("content"))


@query
def tag_edits(spark, sf_dir):
    log = views.activities(spark, sf_dir).filter("type in ('Like', 'Dislike')")
    edits = log.select(
        "object_id", F.when(F.col("type") == "Like", "Add").otherwise("Remove").alias("type"),
        F.concat(F.lit("topic"), F.pmod(F.length("id") + F.length("actor"), F.lit(5))).alias("tag"), "received_at", "id",
    )
    topics = views.object_tags(spark, sf_dir).select("id", F.concat(F.array(F.lit("topic2")), "tags").alias("tags"))
    return variants.apply_tag_edits(topics, edits).select("id", _joined("tags").alias("tags"))


@query
def decision_articles(spark, sf_dir):
    number, turn = F.col("conv_id"), F.col("turn")
    record = F.to_json(F.struct(
        F.concat(F.lit("HEL-"), number.cast("string"), F.lit("-"), turn.cast("string")).alias("register_id"),
        F.col("text").alias("subject"),
        F.when(turn > 0, F.date_format(views.minutes_after_origin(number * 7), "yyyy-MM-dd'T'HH:mm:ss")).alias("latest_decision_date"),
        F.struct(F.upper("role").alias("content")).alias("agenda_item"),
        F.struct(F.col("role").alias("name")).alias("policymaker"),
    ))
    made = variants.decision_articles(views.table(spark, sf_dir, "conversations").select(record.alias("json")))
    return made.select(
        "id", "source", _ntz("published").alias("published"), _ntz("updated").alias("updated"), _field("name").alias("name"),
        _field("summary").alias("summary"), docs.text_field(F.col("object_json"), "attributedTo", "name").alias("author"),
    )


@query
def catalogue_documents(spark, sf_dir):
    number = F.col("doc_id")
    created = F.date_format(views.minutes_after_origin(number * 37 % 43200), "yyyy-MM-dd'T'HH:mm:ss")
    record = F.to_json(F.struct(
        number.cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("notes"),
        F.struct(F.concat(F.lit("sv "), F.col("source")).alias("sv")).alias("title_translated"),
        created.alias("metadata_created"),
    ))
    made = variants.catalogue_documents(views.table(spark, sf_dir, "documents").select(record.alias("json")))
    return made.select(
        "id", "source", _ntz("published").alias("published"), docs.text_field(F.col("object_json"), "nameMap", "sv").alias("name_sv"),
        docs.text_field(F.col("object_json"), "summaryMap", "fi").alias("summary_fi"),
    )


def _waiting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    number = F.regexp_extract("link", r"(\d+)$", 1).cast("bigint")
    waiting = feeds.undated_items(views.feed_xml(spark, sf_dir)).withColumn(
        "first_seen", views.minutes_after_origin(number * 60 % 43200)
    )
    page = F.regexp_extract("page_url", r"(\d+)$", 1)
    metadata = _page_metadata(spark, sf_dir).withColumn("page_url", F.concat(F.lit("https://news.example/"), page))
    return waiting, metadata


@query
def dated_pending(spark, sf_dir):
    """Undated feed items (first seen an hour per number after the origin) against the pages' dates."""
    waiting, metadata = _waiting(spark, sf_dir)
    dated, still = variants.dated_pending(waiting, metadata, F.expr("timestamp_ntz'2024-01-12 00:00:00'"))
    return dated.select("link", _ntz("published").alias("published")).unionByName(still.select("link"), allowMissingColumns=True)


@query
def allowed_pages(spark, sf_dir):
    stored = views.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    hosts = stored.select(urls.authority(F.col("page_url")).alias("host")).filter("host like '%.org'").distinct()
    return enrichment.allowed_pages(stored, hosts).select("page_id", "page_url")
