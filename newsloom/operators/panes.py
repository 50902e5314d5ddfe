"""Reaction counters over a sliding window, kept as daily panes.

A pane is what one object got on one day. The window's counters are sums of panes, so a day that leaves the window takes its
part along, and moving the window needs the panes of the objects that changed, not the log.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators.reactions import event_time


def late_flagged(activities: DataFrame, days: int = 7) -> DataFrame:
    """Likes and dislikes with their ``day`` and ``late``: whether the day had left the window when they arrived.

    It is a matter of the row alone, so it does not depend on the order rows are read in. Without an arrival time no row is late.
    """
    reactions = event_time(activities).filter(F.col("type").isin("Like", "Dislike")).withColumn("day", F.to_date("published"))
    if "received_at" not in reactions.columns:
        return reactions.withColumn("late", F.lit(False))
    return reactions.withColumn("late", F.coalesce(F.col("day") < F.date_sub(F.to_date("received_at"), days), F.lit(False)))


def daily_panes(reactions: DataFrame) -> DataFrame:
    """(object_id, day, like_count, dislike_count); counted before the shuffle, so a popular object is a row per task."""
    return reactions.filter("object_id is not null and day is not null").groupBy("object_id", "day").agg(
        F.count_if(F.col("type") == "Like").alias("like_count"), F.count_if(F.col("type") == "Dislike").alias("dislike_count"))


def window_totals(panes: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Counters of the window that ends on ``as_of``: (object_id, like_count, dislike_count)."""
    return panes.filter(F.col("day") >= F.date_sub(as_of, days)).groupBy("object_id").agg(
        F.sum("like_count").alias("like_count"), F.sum("dislike_count").alias("dislike_count"))


def slid_counters(panes: DataFrame, fresh: DataFrame, before: date | Column | None, as_of: Column, days: int = 7) -> DataFrame:
    """New counters of the objects whose counters a move of the window can change.

    These have panes in ``fresh`` (added since the last move), or one on a day between the window's old and new beginning;
    ``before`` is where the window ended, None before the first move. An object none of whose panes is left gets zeros.
    """
    changed = fresh.select("object_id")
    if before is not None:
        start = before if isinstance(before, Column) else F.lit(before)
        leaving = (F.col("day") >= F.date_sub(start, days)) & (F.col("day") < F.date_sub(as_of, days))
        changed = changed.union(panes.filter(leaving).select("object_id"))
    changed = changed.distinct()
    zero = F.lit(0).cast("long")
    totals = window_totals(panes.join(changed, "object_id", "left_semi"), as_of, days)
    return changed.join(totals, "object_id", "left").select(
        "object_id", F.coalesce("like_count", zero).alias("like_count"), F.coalesce("dislike_count", zero).alias("dislike_count"))
