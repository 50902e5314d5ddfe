"""Operators the design documents describe around the core: other origins, tag edits, user data, history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.documents import CONTEXT, text_field, with_fields
from newsloom.functions.times import parse_iso
from newsloom.functions.urls import BASE
from newsloom.operators.merge import S, merge

# Fixed value: what readers see of a deleted comment.
PLACEHOLDER = "[kommentti poistettu]"


def decision_articles(decisions: DataFrame, column: str = "json", base: str = BASE) -> DataFrame:
    """Decision records as rows for upsert_articles; the register id makes the object id."""
    schema = (
        "register_id string, subject string, latest_decision_date string, modified string,"
        "agenda_item struct<content:string>, policymaker struct<name:string>"
    )
    read = decisions.select(F.from_json(column, schema).alias("d")).select("d.*").filter("register_id is not null")
    rows = read.withColumns(
        {
            "id": F.concat(F.lit(f"{base}/objects/decisions/helsinki/"), F.col("register_id")),
            "published": parse_iso(F.col("latest_decision_date")),
            "changed": parse_iso(F.col("modified")),
        }
    ).filter("published is not null")
    document = F.to_json(
        F.struct(
            F.lit(CONTEXT).alias("@context"), F.lit("Article").alias("type"), "id", F.col("subject").alias("name"),
            F.col("agenda_item.content").alias("summary"), F.col("latest_decision_date").alias("published"),
            F.struct(F.lit("Organization").alias("type"), F.col("policymaker.name").alias("name")).alias("attributedTo"),
        )
    )
    return rows.select(
        "id", F.lit("ahjo").alias("source"), "published", F.coalesce("changed", "published").alias("updated"),
        document.alias("object_json"),
    )


def catalogue_documents(datasets: DataFrame, column: str = "json", base: str = BASE) -> DataFrame:
    """Open-data catalogue records as rows for upsert_articles, names and summaries in two languages."""
    text = "struct<fi:string,sv:string>"
    schema = (
        f"id string, title string, notes string, title_translated {text}, notes_translated {text},"
        "metadata_created string, metadata_modified string"
    )
    read = datasets.select(F.from_json(column, schema).alias("d")).select("d.*").filter("id is not null")
    rows = read.withColumns(
        {
            "object_id": F.concat(F.lit(f"{base}/objects/hri/datasets/"), F.col("id")),
            "published": parse_iso(F.col("metadata_created")),
            "updated": parse_iso(F.col("metadata_modified")),
        }
    ).filter("published is not null")
    document = F.to_json(
        F.struct(
            F.lit(CONTEXT).alias("@context"), F.lit("Document").alias("type"), F.col("object_id").alias("id"),
            F.struct(F.col("title").alias("fi"), F.col("title_translated.sv").alias("sv")).alias("nameMap"),
            F.struct(F.col("notes").alias("fi"), F.col("notes_translated.sv").alias("sv")).alias("summaryMap"),
            F.col("metadata_created").alias("published"), F.col("metadata_modified").alias("updated"),
        )
    )
    return rows.select(
        F.col("object_id").alias("id"), F.lit("hri").alias("source"), "published",
        F.coalesce("updated", "published").alias("updated"), document.alias("object_json"),
    )


def dated_pending(pending: DataFrame, metadata: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Undated items (link, first_seen, ...) split into those a page now dates and those still waiting.

    Items that stay undated for more than ``days`` days are in neither; :func:`expired_pending` has them.
    """
    joined, fresh = _with_page_dates(pending, metadata, now, days)
    return joined.filter("published is not null"), joined.filter(F.col("published").isNull() & fresh).drop("published")


def expired_pending(pending: DataFrame, metadata: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Undated items that no page has dated in ``days`` days, with the reason."""
    joined, fresh = _with_page_dates(pending, metadata, now, days)
    gone = joined.filter(F.col("published").isNull() & ~F.coalesce(fresh, F.lit(False))).drop("published")
    return gone.withColumn("reason", F.when(F.col("first_seen").isNull(), "never seen").otherwise(F.lit(f"no date for {days} days")))


def _with_page_dates(pending: DataFrame, metadata: DataFrame, now: Column, days: int) -> tuple[DataFrame, Column]:
    dates = metadata.groupBy(F.col("page_url").alias("link")).agg(F.max(parse_iso(F.col("published_time"))).alias("published"))
    return pending.drop("published").join(dates, "link", "left"), F.col("first_seen") >= now - F.make_dt_interval(F.lit(days))


def without_actor_data(activities: DataFrame, actors: DataFrame) -> DataFrame:
    """The log without the rows of the given actors (column actor)."""
    return activities.join(actors.select("actor").distinct(), "actor", "left_anti")


def hidden_name(actor: Column, salt: str, base: str = BASE) -> Column:
    """The name an actor who leaves gets. Ids are few and guessable, so without the caller's secret salt the hash
    could be undone by trying them."""
    return F.concat(F.lit(f"{base}/users/"), F.sha2(F.concat(F.lit(salt), actor), 256))


def _names_in(document: Column) -> Column:
    """Whatever in a document can be an id: whole strings, and of addresses every run of whole path segments.

    ``document`` is canonical JSON, so an id stands there as it is, however it was escaped.
    """
    strings = F.regexp_extract_all(document, F.lit(r'"([^"\\]+)"'), F.lit(1))
    found = F.regexp_extract_all(document, F.lit(r"""[^\s"'\\<>()?#,;]*/[^\s"'\\<>()?#,;]+"""), F.lit(0))
    addresses = F.transform(found, lambda address: F.regexp_replace(address, "[.:!]+$", ""))  # a sentence may end here

    def runs(address: Column) -> Column:
        parts = F.split(address, "/")
        n = F.size(parts)
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
            F.sequence(i, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "/"))))

    return F.array_distinct(F.concat(strings, F.flatten(F.transform(F.array_distinct(addresses), runs))))


def anonymised(df: DataFrame, actors: DataFrame, salt: str, base: str = BASE) -> DataFrame:
    """Rows with the given actors under a hashed name, in the actor column and in every document that names them.

    Documents need an ``id`` column to be found again. They are read as JSON, so it does not matter how an id is escaped; it is
    found as a string of its own, in keys too, and inside longer addresses and texts, as far as it stands there in whole words.
    Only documents that name someone are written anew, in canonical form; what is no JSON is gone through as text.
    """
    leaving = actors.select("actor").filter("actor <> ''").distinct()
    if "actor" in df.columns:
        marked = df.join(leaving.withColumn("_leaving", F.lit(True)), "actor", "left")
        name = F.when(F.col("_leaving"), hidden_name(F.col("actor"), salt, base)).otherwise(F.col("actor"))
        df = marked.withColumn("actor", name).select(df.columns)
    if "object_json" not in df.columns:
        return df
    canonical = F.coalesce(F.to_json(F.try_parse_json("object_json")), F.col("object_json"))
    named = df.select("id", F.explode(_names_in(canonical)).alias("actor")).join(leaving, "actor")
    # the longest first: an id may begin another one
    order = F.struct((-F.length("actor")).alias("size"), "actor", hidden_name(F.col("actor"), salt, base).alias("hidden"))
    found = named.groupBy("id").agg(F.sort_array(F.collect_set(order)).alias("_named"))

    def renamed(document: Column, one: Column) -> Column:
        whole = F.concat(F.lit(r"(?<![\w-])\Q"), one["actor"], F.lit(r"\E(?![\w-])"))
        return F.regexp_replace(document, whole, one["hidden"])

    return df.join(found, "id", "left").withColumn(
        "object_json", F.when(F.col("_named").isNull(), F.col("object_json")).otherwise(F.aggregate("_named", canonical, renamed))
    ).select(df.columns)


def partial_state(activities: DataFrame) -> DataFrame:
    """What a part of the log says of each object, in a form that can be merged with what other parts say."""
    order = F.struct("received_at", "id")
    return activities.filter("object_id is not null").groupBy("object_id").agg(
        F.max(F.struct("received_at", "id", "type")).alias("last"),
        (F.count_if(F.col("type") == "Delete") > 0).alias("deleted"),
        F.min(F.when(F.col("type") == "Create", F.struct(order.alias("at"), F.col("actor").alias("actor")))).alias("created"),
    )


def merged_states(*parts: DataFrame) -> DataFrame:
    """The partial state of several parts of the log together, in whatever order they come."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("object_id").agg(F.max("last").alias("last"), F.max("deleted").alias("deleted"), F.min("created").alias("created"))


def shown_state(partial: DataFrame) -> DataFrame:
    """Per object: last activity type and time, deletion, creator."""
    return partial.select(
        "object_id", F.col("last.type").alias("last_type"), F.col("last.received_at").alias("last_at"), "deleted",
        F.col("created.actor").alias("creator"))


def state_from_log(activities: DataFrame) -> DataFrame:
    """Per object: last activity type and time, deletion, creator; one partial aggregation over the log."""
    return shown_state(partial_state(activities))


class StateSnapshots:
    """Partial states of the log up to some moment, each in a folder named after it.

    The current state is the newest snapshot merged with what arrived since, so only the tail of the log is read. Rows
    arrive in order of ``received_at``; a moment to take a snapshot at has passed for all of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def moments(self) -> list[datetime]:
        """When there are snapshots of, the newest last. One that was not written to its end does not count."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in system.listStatus(folder)] if system.exists(folder) else []
        done = [p.getName() for p in names if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(datetime.strptime(name, "before-%Y%m%dT%H%M%S") for name in done if name.startswith("before-"))

    def _folder(self, moment: datetime) -> str:
        return f"{self.path}/before-{moment:%Y%m%dT%H%M%S}"

    def _up_to(self, activities: DataFrame, end: datetime | None) -> DataFrame:
        start = max((m for m in self.moments() if end is None or m < end), default=None)
        if start is not None:
            activities = activities.filter(F.col("received_at") >= F.lit(start).cast(activities.schema["received_at"].dataType))
        if end is not None:
            activities = activities.filter(F.col("received_at") < F.lit(end).cast(activities.schema["received_at"].dataType))
        tail = partial_state(activities)
        return tail if start is None else merged_states(self.spark.read.parquet(self._folder(start)), tail)

    def take(self, activities: DataFrame, moment: datetime) -> None:
        """Write a snapshot of everything that arrived before ``moment`` (a full second), from the one before it and what came since."""
        if moment not in self.moments():
            self._up_to(activities, moment).write.mode("overwrite").parquet(self._folder(moment))

    def current(self, activities: DataFrame) -> DataFrame:
        """The result of :func:`state_from_log`."""
        return shown_state(self._up_to(activities, None))


def with_placeholders(objects: DataFrame) -> DataFrame:
    """Deleted notes that have replies keep their place with a placeholder text.

    Only the documents of those notes are rewritten; they are merged into the others by id.
    """
    parents = objects.select(text_field(F.col("object_json"), "inReplyTo").alias("id")).filter("id is not null").distinct()
    gone = objects.filter(F.col("deleted") & (text_field(F.col("object_json"), "type") == "Note")).select("id", "object_json")
    shown = with_fields(gone.join(parents, "id", "left_semi"), "object_json", {"content": F.lit(PLACEHOLDER)})
    return merge(objects, shown, {"object_json": S("object_json")}, order=[F.desc("object_json")])


def apply_tag_edits(objects: DataFrame, edits: DataFrame) -> DataFrame:
    """Tags after Add and Remove activities (object_id, type, tag, received_at, id): the last edit of a tag counts.

    Edits are reduced to one row per object and tag before they meet the objects.
    """
    order = F.struct("received_at", "id")
    last = edits.groupBy(F.col("object_id").alias("id"), "tag").agg(F.max_by("type", order).alias("type"))
    folded = last.groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(F.col("type") == "Add", F.col("tag")))).alias("_added"),
        F.collect_set(F.when(F.col("type") == "Remove", F.col("tag"))).alias("_removed"),
    )
    changed = F.array_union(F.filter("tags", lambda tag: ~F.array_contains("_removed", tag)), F.col("_added"))
    return objects.join(folded, "id", "left").withColumn(
        "tags", F.when(F.col("_added").isNotNull(), changed).otherwise(F.col("tags"))
    ).drop("_added", "_removed")
