"""Counters and recency from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators.merge import S, merge
from newsloom.operators.objects import in_window


def _count(kind: str, column: str = "type") -> Column:
    return F.count_if(F.col(column) == kind)


def event_time(activities: DataFrame) -> DataFrame:
    """``published`` never after the arrival: it is set by users' devices, and a date ahead would count for ever."""
    if "received_at" not in activities.columns:
        return activities
    kind = activities.schema["published"].dataType
    return activities.withColumn("published", F.least(F.col("published"), F.col("received_at").cast(kind)))


def reaction_counts(activities: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Likes and dislikes per object logged in the window, both in one pass."""
    logged = in_window(activities.filter(F.col("type").isin("Like", "Dislike")), as_of, days)
    recent = in_window(event_time(logged).drop("published_date"), as_of, days)
    return recent.groupBy("object_id").agg(
        _count("Like").alias("like_count"), _count("Dislike").alias("dislike_count")
    )


def reaction_counts_current(reactions: DataFrame) -> DataFrame:
    """All-time counters from the current reaction of each actor."""
    return reactions.groupBy("object_id").agg(
        _count("Like", "reaction_type").alias("like_count"), _count("Dislike", "reaction_type").alias("dislike_count")
    )


def without_deleted(activities: DataFrame) -> DataFrame:
    """Activities whose object has no Delete in the log; activities without an object are kept."""
    deletes = activities.filter(F.col("type") == "Delete").select("object_id").distinct()
    return activities.join(deletes, "object_id", "left_anti")


def last_activity(activities: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Latest arrival per thread root (the object itself when there is no root).

    Rows are reduced per (object, root) before the join with deletes, so a popular object is a handful of
    rows by then. With ``objects``, reactions to a comment count for the comment's thread instead.
    """
    touching = activities.filter(F.col("type").isin("Like", "Dislike", "Create"))
    reduced = touching.groupBy("object_id", "thread_root").agg(F.max("received_at").alias("last_activity_at"))
    deletes = activities.filter(F.col("type") == "Delete").select("object_id").distinct()
    kept = reduced.join(deletes, "object_id", "left_anti")
    root = F.coalesce("thread_root", "object_id")
    if objects is not None:
        roots = objects.select(
            F.col("id").alias("object_id"), F.get_json_object("object_json", "$.thread_root").alias("note_root")
        )
        kept = kept.join(roots, "object_id", "left")
        root = F.coalesce("thread_root", "note_root", "object_id")
    return kept.groupBy(root.alias("id")).agg(F.max("last_activity_at").alias("last_activity_at"))


def actor_object_counts(activities: DataFrame) -> DataFrame:
    """Activities of every actor on every object."""
    return activities.groupBy("actor", "object_id").agg(F.count("*").alias("n_activities"))


def apply_reaction_counts(objects: DataFrame, counts: DataFrame) -> DataFrame:
    """Write counters to live objects; objects without a recent reaction keep theirs."""
    source = counts.filter(F.col("object_id").isNotNull()).select(
        F.col("object_id").alias("id"), "like_count", "dislike_count"
    )
    return merge(
        objects, source, {name: S(name) for name in ["like_count", "dislike_count"]}, when=~F.col("deleted")
    )


def apply_last_activity(objects: DataFrame, last: DataFrame) -> DataFrame:
    """Move ``updated`` forward; it never moves back, and an unset value stays unset."""
    return merge(
        objects,
        last.select("id", "last_activity_at"),
        {"updated": S("last_activity_at")},
        when=S("last_activity_at") > F.col("updated"),
    )


def counter_changes(counts: DataFrame, last: DataFrame) -> DataFrame:
    """Counters (object_id, ...) and recency (id, last_activity_at) as one row per object."""
    both = counts.withColumnRenamed("object_id", "id").unionByName(last, allowMissingColumns=True)
    return both.filter(F.col("id").isNotNull()).groupBy("id").agg(
        *[F.max(name).alias(name) for name in ["like_count", "dislike_count", "last_activity_at"]])


def apply_counter_changes(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """apply_reaction_counts and apply_last_activity in one merge."""
    counted = S("like_count").isNotNull() & ~F.col("deleted")
    newer = F.coalesce(S("last_activity_at") > F.col("updated"), F.lit(False))
    return merge(
        objects,
        changes,
        {
            "like_count": F.when(counted, S("like_count")).otherwise(F.col("like_count")),
            "dislike_count": F.when(counted, S("dislike_count")).otherwise(F.col("dislike_count")),
            "updated": F.when(newer, S("last_activity_at")).otherwise(F.col("updated")),
        },
    )


def refresh_counters(objects: DataFrame, activities: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Counters and recency together.

    The two results share the object key, so they are folded into one row per object and the objects table
    is joined and rewritten once instead of twice.
    """
    return apply_counter_changes(objects, counter_changes(reaction_counts(activities, as_of, days), last_activity(activities)))


def actor_stats(activities: DataFrame) -> DataFrame:
    """Likes, dislikes and comments of every actor."""
    return activities.groupBy("actor").agg(
        _count("Like").alias("n_likes"), _count("Dislike").alias("n_dislikes"), _count("Create").alias("n_comments")
    )
