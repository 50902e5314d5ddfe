"""The batch jobs as streams: reaction counters, current reactions and article upserts.

Each stream writes its changes only; nothing rewrites a large table per micro-batch. The matching
``current_*`` function folds the changes into the state the batch job would have produced.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from newsloom.operators.merge import latest_per_key
from newsloom.operators.objects import upsert_articles
from newsloom.operators.panes import daily_panes, late_flagged, slid_counters, window_totals
from newsloom.operators.reactions import apply_reaction_counts
from newsloom.session import stage
from newsloom.sources.tables import rewrite_touched
from newsloom.streaming.reactions import PROVIDER, current_reaction_changes
from newsloom.streaming.versions import compact, live_runs, newest, read_versions, summed, write_version

COUNTS = "object_id string, day date, like_count bigint, dislike_count bigint"
LIKES = "activity_id string, actor string, object_id string, reaction_type string, published timestamp"
ARTICLES = "id string, source string, published timestamp, updated timestamp, object_json string"
APPLIED = "as_of date, counted bigint"
ACTIVITIES = "type string, object_id string, published timestamp, received_at timestamp"
DAYS = 7


def _start(stream: DataFrame, handle, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def stream_reaction_counts(
    activities: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, days: int = DAYS
) -> StreamingQuery:
    """Collect daily panes of likes and dislikes; each micro-batch writes what it adds to them.

    Panes are sums, so no state is kept and rows may come in any order. The day is that of :func:`event_time`. A row that
    arrives when its day has left the window cannot count any more; it is in ``{path}-late``. :func:`slide_counters`
    takes the panes into the objects.
    """
    spark = activities.sparkSession

    def handle(rows: DataFrame, batch: int) -> None:
        reactions = late_flagged(rows, days).persist()
        write_version(daily_panes(reactions.filter("not late")), path, batch)
        late = reactions.filter("late").select(*[c for c in _schema(ACTIVITIES).names if c in reactions.columns])
        write_version(late, f"{path}-late", batch)
        reactions.unpersist()
        compact(spark, path, _schema(COUNTS), summed_panes)

    return _start(activities, handle, checkpoint, trigger=trigger)


def summed_panes(rows: DataFrame) -> DataFrame:
    """Panes of several versions as one, sorted by day, so that a reader of some days skips the others."""
    return summed(["object_id", "day"], ["like_count", "dislike_count"])(rows).sortWithinPartitions("day")


def late_reactions_of_days(spark: SparkSession, path: str) -> DataFrame:
    """Reactions that arrived when their day had left the window."""
    return read_versions(spark, f"{path}-late", _schema(ACTIVITIES)).drop("version")


def current_reaction_counts(spark: SparkSession, path: str, as_of: Column, days: int = DAYS) -> DataFrame:
    """Counters of the last days, as reaction_counts would return them."""
    return window_totals(read_versions(spark, path, _schema(COUNTS)), as_of, days)


def slide_counters(spark: SparkSession, root: str, path: str, as_of: date, days: int = DAYS) -> int:
    """Bring the stored objects' counters to the window that ends on ``as_of``; returns the number of objects looked at.

    Looked at are objects with panes written since the last call and objects with a pane on a day that left the window
    meanwhile; their dates alone are rewritten. Counters are sums over the window, not differences, so a call that failed is
    repeated with the same result; where it got to is written last.
    """
    applied = read_versions(spark, f"{path}-applied", _schema(APPLIED)).orderBy(F.desc("version")).first()
    before, counted, call = (applied["as_of"], applied["counted"], applied["version"] + 1) if applied else (None, -1, 0)
    runs = live_runs(spark, path)
    upto = runs[-1][1] if runs else -1
    panes = read_versions(spark, path, _schema(COUNTS), before=upto + 1)
    fresh = read_versions(spark, path, _schema(COUNTS), before=upto + 1, since=counted)
    changed = stage(slid_counters(panes, fresh, before, F.lit(as_of), days).withColumnRenamed("object_id", "id"), "slid")
    rewrite_touched(spark, root, "objects", changed, lambda rows, source: apply_reaction_counts(rows, source.withColumnRenamed("id", "object_id")))
    marker = spark.createDataFrame([(as_of, upto)], APPLIED)
    write_version(marker, f"{path}-applied", call)
    compact(spark, f"{path}-applied", _schema(APPLIED), lambda rows: rows.orderBy(F.desc("version")).limit(1))
    return changed.count()


def stream_reaction_state(attempts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the current reaction of every actor and object.

    ``attempts`` are valid reaction requests (request_id, activity_id, type, actor, target_id, received_at). What a
    micro-batch needs to know is in the state store under its own keys (see streaming/reactions.py); it reads no earlier
    output. Requests may come in any order and more than once; those too late to be put in their place are in ``{path}-late``.
    """
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def handle(changed: DataFrame, batch: int) -> None:
        changed = changed.persist()
        write_version(changed.filter("kind = 'state'").select(*_schema(LIKES).names), path, batch)
        write_version(changed.filter("kind = 'late'").select("request_id", *_schema(LIKES).names), f"{path}-late", batch)
        changed.unpersist()
        compact(spark, path, _schema(LIKES), newest("actor", "object_id"))

    return _start(current_reaction_changes(attempts), handle, checkpoint, "update", trigger)


def current_reactions(spark: SparkSession, path: str) -> DataFrame:
    """One row per actor and object: the newest version."""
    return newest("actor", "object_id")(read_versions(spark, path, _schema(LIKES))).drop("version")


def late_reactions(spark: SparkSession, path: str) -> DataFrame:
    """Requests that came too late to count: (request_id, activity_id, actor, object_id, reaction_type, published)."""
    return read_versions(spark, f"{path}-late", _schema("request_id string, " + LIKES)).drop("version")


def newest_articles(rows: DataFrame) -> DataFrame:
    """Per article the highest update time and, among equals, the earliest version: merging one after the other gives that."""
    return latest_per_key(rows, "id", [F.desc("updated"), F.asc("version")])


def stream_upsert_articles(articles: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Collect article versions; each micro-batch writes one version per article, and full levels of versions are folded."""
    spark = articles.sparkSession

    def handle(rows: DataFrame, batch: int) -> None:
        one = latest_per_key(rows, "id", [F.desc("updated"), F.desc("object_json")])
        write_version(one.select(*_schema(ARTICLES).names), path, batch)
        compact(spark, path, _schema(ARTICLES), newest_articles)

    return _start(articles, handle, checkpoint, trigger=trigger)


def compacted_articles(objects: DataFrame, path: str) -> DataFrame:
    """Objects with all collected versions merged in."""
    changes = read_versions(objects.sparkSession, path, _schema(ARTICLES))
    return upsert_articles(objects, newest_articles(changes).drop("version"))
