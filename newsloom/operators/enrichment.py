"""Page metadata merged into pending articles, and articles made from scraped pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.documents import article_document, text_field, with_fields
from newsloom.functions.text import longer, non_blank
from newsloom.functions.times import parse_iso, rfc3339
from newsloom.functions.urls import BASE, authority, is_http_url, scraped_id, site
from newsloom.operators.merge import latest_per_key
from newsloom.operators.objects import apply_og, is_pending_og, pending_og
from newsloom.session import stage


def merged_fields(document: Column, page: dict[str, Column]) -> dict[str, Column]:
    """Field rules: the longer name and summary win, the page's image and update time win, the publication
    time is only filled in when the article has none."""
    image = F.when(page["image"] != "", F.struct(F.lit("Image").alias("type"), page["image"].alias("url")))
    published = F.when(
        F.coalesce(text_field(document, "published"), F.lit("")) == "", F.nullif(page["published_time"], F.lit(""))
    )
    return {
        "name": longer(text_field(document, "name"), page["title"]),
        "summary": longer(text_field(document, "summary"), page["description"]),
        "image": image,
        "published": published,
        "updated": F.nullif(page["modified_time"], F.lit("")),
    }


def page_results(pending: DataFrame, pages: DataFrame) -> DataFrame:
    """``pending`` with its document, flag and error text as the page metadata leave them; other columns are carried along.

    ``pages`` has one row of metadata per ``page_url``. Rows whose document cannot be read are left as they are, pending;
    every other row is marked as processed, found or not, so that no row is retried for ever.
    """
    readable = F.json_object_keys("object_json").isNotNull()
    url = F.when(readable, F.nullif(text_field(F.col("object_json"), "url"), F.lit("")))
    wanted = pending.withColumns({"_readable": readable, "page_url": url})
    names = ["title", "description", "image", "published_time", "modified_time"]
    unique = latest_per_key(pages, "page_url", [F.col(name) for name in names])
    joined = wanted.join(unique.select("page_url", *names, F.lit(True).alias("found")), "page_url", "left")
    fields = merged_fields(F.col("object_json"), {name: F.col(name) for name in names})
    fields["image"] = F.parse_json(F.to_json(fields["image"]))
    error = F.when(F.col("page_url").isNull(), "Missing url in object_json").when(
        F.col("found").isNull(), "Fetch/Parse error: no page"
    )
    results = {
        "object_json": F.when(F.col("found"), F.col("enriched")).otherwise(F.col("object_json")),
        "og_enriched": F.col("og_enriched") | F.col("_readable"),
        "og_enriched_error": F.when(F.col("_readable"), error).otherwise(F.col("og_enriched_error")),
    }
    done = with_fields(joined, "object_json", fields, out="enriched").withColumns(results)
    return done.select(*pending.columns)


def og_results(pending: DataFrame, pages: DataFrame) -> DataFrame:
    """Outcome for every pending article (id, object_json) that can be read: the document, enriched where its page is known, the flag and the error."""
    unmarked = pending.withColumns({"og_enriched": F.lit(False), "og_enriched_error": F.lit(None).cast("string")})
    results = page_results(unmarked.filter(F.json_object_keys("object_json").isNotNull()), pages)
    return results.select("id", "object_json", "og_enriched", "og_enriched_error")


def enrich_in_place(objects: DataFrame, pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """:func:`enrich_pages` for a table that is written out: a row whose id no other row has takes its result with it, and no join by id moves documents.

    Rows that share an id take the best of their results, as in the merge.
    """
    often = keep(objects.groupBy("id").count().filter("count > 1 and id is not null").select("id", F.lit(True).alias("_shared")))
    marked = objects.join(often, "id", "left").withColumn("_shared", F.coalesce("_shared", F.lit(False)))
    # what has no id is no merge's target
    waits = F.coalesce(is_pending_og() & F.col("id").isNotNull(), F.lit(False))
    done = keep(page_results(marked.filter(waits), pages))
    shared = apply_og(marked.filter("_shared"), done.filter("_shared and og_enriched"))
    alone = marked.filter(~F.col("_shared") & ~waits).unionByName(done.filter("not _shared"))
    return alone.unionByName(shared).select(*objects.columns)


def enrich_pages(
    objects: DataFrame, pages: DataFrame, sources: Sequence[str] | None = None, batch: int | None = None
) -> DataFrame:
    """Objects with page metadata merged into all pending articles."""
    return apply_og(objects, og_results(pending_og(objects, sources, batch), pages))


def scraped_articles(pages: DataFrame, now: Column, base: str = BASE) -> DataFrame:
    """Rows for :func:`upsert_scraped` from page metadata (``page_url`` plus the metadata columns).

    A page needs an http(s) address and a title. Missing or unreadable dates become the scrape time, and
    one unreadable date resets neither the other one nor the row.
    """
    now = now.cast("timestamp")
    titled = pages.withColumn("title", non_blank(F.col("title"))).filter(
        is_http_url(F.col("page_url")) & F.col("title").isNotNull()
    )
    times = {"published": "published_time", "updated": "modified_time"}
    rows = titled.withColumns(
        {"id": scraped_id(F.col("page_url"), base)} | {f"{name}_valid": parse_iso(F.col(raw)) for name, raw in times.items()}
    )
    for name, raw in times.items():
        valid = F.col(f"{name}_valid")
        text = F.when(valid.isNotNull(), F.col(raw)).otherwise(rfc3339(now))
        rows = rows.withColumns({name: F.coalesce(valid, now), f"{name}_text": text})
    document = article_document(
        id=F.col("id"),
        url=F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("page_url")),
        name=F.col("title"),
        summary=non_blank(F.col("description")),
        published=F.col("published_text"),
        updated=F.col("updated_text"),
        author=F.coalesce(F.nullif(F.col("site_name"), F.lit("")), authority(F.col("page_url"))),
        author_url=site(F.col("page_url")),
        image_url=F.col("image"),
    )
    return rows.select("id", "published", "updated", document.alias("object_json"))


def rejected_pages(pages: DataFrame) -> DataFrame:
    """Pages that scraped_articles leaves out, with the reason."""
    reason = F.when(~F.coalesce(is_http_url(F.col("page_url")), F.lit(False)), "no http address").when(
        non_blank(F.col("title")).isNull(), "no title")
    return pages.withColumn("reason", reason).filter("reason is not null")


def allowed_pages(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages of listed hosts (column host)."""
    return pages.withColumn("host", authority(F.col("page_url"))).join(hosts, "host", "left_semi").drop("host")
