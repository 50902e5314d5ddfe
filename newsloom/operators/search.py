"""Tag search: relevance ranking, totals and the ordered collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions.documents import CONTEXT, with_live_fields
from newsloom.functions.text import strip
from newsloom.functions.urls import BASE
from newsloom.operators.objects import live

DEFAULT_N = 50
MAX_N = 500


def ranking() -> list[Column]:
    """Order of search results: relevance, popularity, activity, age; the id makes it total."""
    return [
        F.desc("relevance"), F.desc("like_count"), F.desc("updated"), F.desc_nulls_last("published"), F.asc("id"),
    ]


def normalise_tags(tags: Sequence[str]) -> list[str]:
    """Trimmed lower-case tags of one search; at least one has to remain."""
    cleaned = [tag.strip().lower() for tag in tags if tag.strip()]
    if not cleaned:
        raise ValueError("at least one tag is required")
    return cleaned


def check_n(n: int) -> int:
    if not 1 <= n <= MAX_N:
        raise ValueError(f"n must be between 1 and {MAX_N}")
    return n


def _literal(tags: Sequence[str]) -> Column:
    return F.array(*[F.lit(tag) for tag in tags])


def match_tags(objects: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Objects with at least one of the tags."""
    return objects.filter(F.arrays_overlap("tags", _literal(normalise_tags(tags))))


def relevance(tags: Column, search: Column) -> Column:
    """How many of the object's tags are searched for; a tag the object has twice counts twice."""
    return F.size(F.filter(tags, lambda tag: F.array_contains(search, tag))).cast("bigint")


def outbox(objects: DataFrame, tags: Sequence[str], n: int = DEFAULT_N) -> DataFrame:
    """The n best live objects for the tags, without their documents.

    Only the narrow ranking columns are read; the sort is a distributed top-k, not a full sort.
    """
    check_n(n)
    search = normalise_tags(tags)
    keep = [name for name in ["id", "source", "published", "updated", "like_count", "published_date"]
            if name in objects.columns]
    return (
        match_tags(live(objects), search)
        .select(*keep, relevance(F.col("tags"), _literal(search)).alias("relevance"))
        .orderBy(*ranking())
        .limit(n)
    )


def outbox_items(objects: DataFrame, tags: Sequence[str], n: int = DEFAULT_N) -> DataFrame:
    """The outbox with documents as readers see them.

    Documents are fetched for the winners only: at most MAX_N ids are broadcast, and on a table partitioned
    by ``published_date`` their dates prune the second scan. Rows without a readable document are dropped
    after the limit, so fewer than n may come back.
    """
    # always true after the match; a comparison on the small side is what lets Spark prune partitions by it
    winners = outbox(objects, tags, n).filter(F.col("relevance") > 0)
    keys = [name for name in ["id", "published_date"] if name in winners.columns]
    documents = objects.select(*keys, "object_json")
    found = with_live_fields(documents.join(F.broadcast(winners), keys), "object_json", "document")
    return found.filter(F.col("document").isNotNull()).drop("object_json").orderBy(*ranking())


def total_items(objects: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row: how many live objects match."""
    return match_tags(live(objects), tags).agg(F.count("*").alias("total_items"))


def self_url(tags: Sequence[str], n: int, base: str = BASE) -> str:
    return f"{base}/outbox?" + "&".join(f"tag={tag}" for tag in tags) + f"&n={n}"


def outbox_document(
    items: DataFrame, total: DataFrame, tags: Sequence[str], n: int = DEFAULT_N, base: str = BASE
) -> DataFrame:
    """One row: the ordered collection as a JSON document.

    ``items`` is the bounded result of :func:`outbox_items` (at most MAX_N rows).
    """
    order = F.struct(
        -F.col("relevance"), -F.col("like_count"), F.col("updated").isNull(), -F.unix_micros(F.col("updated").cast("timestamp")),
        F.col("published").isNull(), -F.unix_micros(F.col("published").cast("timestamp")), F.col("id"),
    )
    placed = items.select(F.struct(order.alias("place"), F.col("document")).alias("item"))
    collected = placed.unionByName(total.select("total_items"), allowMissingColumns=True).agg(
        F.transform(F.sort_array(F.collect_list("item")), lambda item: F.parse_json(item["document"])).alias("ordered"),
        F.max("total_items").alias("total_items"),
    )
    document = F.to_json(
        F.struct(
            F.lit(CONTEXT).alias("@context"),
            F.lit("OrderedCollection").alias("type"),
            F.lit(self_url(normalise_tags(tags), n, base)).alias("id"),
            F.col("total_items").alias("totalItems"),
            F.col("ordered").alias("orderedItems"),
        )
    )
    return collected.select(document.alias("document"))


def checked_searches(searches: DataFrame) -> DataFrame:
    """Every search (search_id, tags, n) with its clean tags, the default n, and status and reason.

    status 200: it can be answered; 400: no usable tag, or n out of bounds. ``tags`` keeps repeats as typed,
    ``search`` has each tag once.
    """
    cleaned = F.filter(F.transform("tags", lambda tag: F.lower(strip(tag))), lambda tag: tag != "")
    usable = F.coalesce(cleaned, F.array().cast("array<string>"))
    size = F.coalesce(F.col("n"), F.lit(DEFAULT_N)) if "n" in searches.columns else F.lit(DEFAULT_N)
    reason = F.when(F.size("tags") == 0, "at least one tag is required").when(
        ~F.col("n").between(1, MAX_N), f"n must be between 1 and {MAX_N}"
    )
    return (
        searches.select("search_id", usable.alias("tags"), size.alias("n"))
        .withColumns({"search": F.array_distinct("tags"), "reason": reason})
        .withColumn("status", F.when(F.col("reason").isNull(), 200).otherwise(400))
    )


def normalised_searches(searches: DataFrame) -> DataFrame:
    """The searches that can be answered; :func:`checked_searches` also has the others and says why not."""
    return checked_searches(searches).filter("status = 200").drop("status", "reason")


def search_url(tags: Column, n: Column, base: str = BASE) -> Column:
    """Address of a search as a column; a tag typed twice is in it twice."""
    pairs = F.array_join(F.transform(tags, lambda tag: F.concat(F.lit("tag="), tag)), "&")
    return F.concat(F.lit(f"{base}/outbox?"), pairs, F.lit("&n="), n.cast("string"))


def outbox_many(objects: DataFrame, searches: DataFrame) -> DataFrame:
    """The outbox for a whole table of searches (search_id, tags array, optional n).

    Shared tags are counted per search and object, before the shuffle as far as a task holds them; the ranking window
    keeps at most MAX_N rows per search and task before the next one. A small table of searches is broadcast by
    size; a large one is joined on the tag, where AQE splits hot tags.
    """
    wanted = normalised_searches(searches).select("search_id", "n", F.explode("search").alias("tag"))
    columns = ["id", "published", "updated", "like_count"]
    candidates = live(objects).select(*columns, F.explode("tags").alias("tag"))
    scored = candidates.join(wanted, "tag").groupBy("search_id", "n", *columns).agg(F.count("*").alias("relevance"))
    place = F.row_number().over(Window.partitionBy("search_id").orderBy(*ranking()))
    return (
        scored.select("search_id", "n", "id", "published", "updated", "like_count", "relevance")
        .withColumn("place", place.cast("bigint"))
        .filter(F.col("place") <= MAX_N)
        .filter(F.col("place") <= F.col("n"))
        .drop("n")
    )
