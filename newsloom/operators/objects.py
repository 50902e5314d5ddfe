"""The objects table: selection, upserts and schema migration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators.merge import S, merge


def live(objects: DataFrame) -> DataFrame:
    """Rows that are not deleted (an unknown flag does not count as live)."""
    return objects.filter(~F.col("deleted"))


def lookup_objects(ids: DataFrame, objects: DataFrame) -> DataFrame:
    """Current state for every id in ``ids`` (column id); missing objects have NULL columns."""
    state = objects.select("id", "source", "object_json", "deleted", "like_count", "dislike_count")
    return ids.join(state, "id", "left")


def is_pending_og(sources: Sequence[str] | None = None) -> Column:
    """True for live articles without page metadata (NULL where that is unknown); for ``sources`` see :func:`pending_og`."""
    origin = F.col("source").isin(*sources) if sources else ~F.col("source").isin("scraped", "user")
    return ~F.col("deleted") & origin & ~F.col("og_enriched")


def pending_og(objects: DataFrame, sources: Sequence[str] | None = None, batch: int | None = None) -> DataFrame:
    """Live articles without page metadata, newest first.

    Without ``sources`` every feed source qualifies: scraped rows arrive enriched and users' notes have no page.
    """
    pending = objects.filter(is_pending_og(sources))
    if batch is None:
        return pending.select("id", "object_json")
    newest = pending.select("id", "published").orderBy(F.desc("published"), "id").limit(batch)
    # the wide documents are fetched for the chosen rows only; the limit tells Spark how small that side is
    return pending.select("id", "object_json").join(newest.select("id"), "id", "left_semi")


def in_window(df: DataFrame, as_of: Column, days: int = 7, time: str = "published") -> DataFrame:
    """Rows of the last ``days`` days and today, by UTC date.

    On a table partitioned by ``published_date`` the predicate prunes partitions.
    """
    date = F.col("published_date") if time == "published" and "published_date" in df.columns else F.to_date(time)
    return df.filter(date >= F.date_sub(as_of, days))


_NEW_ROW = {
    "tags": F.array, "tags_enriched": lambda: F.lit(False), "og_enriched": lambda: F.lit(False),
    "like_count": lambda: F.lit(0), "dislike_count": lambda: F.lit(0), "deleted": lambda: F.lit(False),
}


def _new_row(**columns: Column) -> dict[str, Column]:
    """Insert values: counters at zero, flags off, no tags, then ``columns``."""
    return {name: make() for name, make in _NEW_ROW.items()} | columns


def upsert_articles(objects: DataFrame, articles: DataFrame) -> DataFrame:
    """Feed articles: newer versions replace the document; tags, counters and flags stay with their owners."""
    columns = ["source", "published", "updated", "object_json"]
    return merge(
        objects,
        articles.select("id", *columns),
        {name: S(name) for name in columns},
        when=S("updated") > F.col("updated"),
        insert=_new_row(**{name: F.col(name) for name in ["id", *columns]}),
        order=[F.desc("updated"), F.desc("published"), F.desc("object_json"), F.desc("source")],
    )


def upsert_scraped(objects: DataFrame, scraped: DataFrame) -> DataFrame:
    """Scraped pages: never overwrite a row that came from a feed."""
    columns = ["published", "updated", "object_json"]
    return merge(
        objects,
        scraped.select("id", *columns),
        {"object_json": S("object_json"), "updated": S("updated"), "og_enriched": F.lit(True)},
        when=F.col("source") == "scraped",
        insert=_new_row(
            **{name: F.col(name) for name in ["id", *columns]}, source=F.lit("scraped"), og_enriched=F.lit(True)
        ),
        order=[F.desc("updated"), F.desc("published"), F.desc("object_json")],
    )


def upsert_notes(objects: DataFrame, notes: DataFrame, now: Column | None = None) -> DataFrame:
    """Users' notes. ``now`` is the write time; without it each note's own ``updated`` is used."""
    source = notes.select("id", "published", "object_json", (F.col("updated") if now is None else now).alias("updated"))
    return merge(
        objects,
        source,
        {"object_json": S("object_json"), "updated": S("updated")},
        insert=_new_row(
            id=F.col("id"), source=F.lit("user"), published=F.col("published"), updated=F.col("updated"),
            object_json=F.col("object_json"),
        ),
        order=[F.desc("updated"), F.desc("published"), F.desc("object_json")],
    )


def apply_tags(objects: DataFrame, tags: DataFrame) -> DataFrame:
    """Write tags; an empty or failed result still marks the row as done, so it is not retried for ever."""
    return merge(
        objects,
        tags.select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")),
        {"tags": S("tags"), "tags_enriched": F.lit(True)},
        order=[F.desc("tags")],
    )


def apply_og(objects: DataFrame, results: DataFrame) -> DataFrame:
    """Write page-metadata results: the document, the flag and the error text; row times stay."""
    columns = ["object_json", "og_enriched", "og_enriched_error"]
    order = [F.asc_nulls_first("og_enriched_error"), F.desc("object_json")]
    return merge(objects, results.select("id", *columns), {name: S(name) for name in columns}, order=order)


def apply_updates(objects: DataFrame, edits: DataFrame, now: Column | None = None) -> DataFrame:
    """Write edited documents (id, object_json and, without ``now``, updated)."""
    source = edits.select("id", "object_json", (F.col("updated") if now is None else now).alias("updated"))
    order = [F.desc("updated"), F.desc("object_json")]
    return merge(objects, source, {"object_json": S("object_json"), "updated": S("updated")}, order=order)


def soft_delete(objects: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """Mark ids as deleted; ids without ``now`` carry their own ``updated``."""
    source = ids.select("id", (F.col("updated") if now is None else now).alias("updated"))
    return merge(objects, source, {"deleted": F.lit(True), "updated": S("updated")}, order=[F.asc("updated")])


def migrate_objects(objects: DataFrame) -> DataFrame:
    """Add the columns later versions brought in, if absent; a missing og flag becomes false. Repeatable."""
    added = {"dislike_count": "bigint", "og_enriched": "boolean", "og_enriched_error": "string"}
    for name, kind in added.items():
        if name not in objects.columns:
            objects = objects.withColumn(name, F.lit(None).cast(kind))
    return objects.withColumn("og_enriched", F.coalesce("og_enriched", F.lit(False)))
