"""Comment threads: which article a comment belongs to, at most two levels deep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.documents import text_field

DEEP = "reply thread depth limit exceeded"
NO_PARENT = "parent object not found or deleted"
BAD_PARENT = "unsupported parent object type"


def thread_facts(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """What a thread decision needs to know of the given objects (column id, distinct).

    Documents are read before the join, so that it shuffles the few facts and not the documents. An inner join on distinct
    ids keeps them there; Spark would move a semi join below the reading.
    """
    document = F.from_json("object_json", "type string, attributedTo string, inReplyTo string, thread_root string")
    read = objects.select("id", "deleted", document.alias("document")).join(ids, "id")
    return read.select(
        "id",
        "deleted",
        F.col("document.type").alias("kind"),
        F.col("document.attributedTo").alias("owner"),
        F.nullif(F.col("document.inReplyTo"), F.lit("")).alias("in_reply_to"),
        F.nullif(F.col("document.thread_root"), F.lit("")).alias("thread_root"),
    )


def with_parent_kind(facts: DataFrame, objects: DataFrame) -> DataFrame:
    """Add ``parent_kind``: the type of the object each note replies to, deleted or not."""
    above = facts.filter("in_reply_to is not null").select(F.col("in_reply_to").alias("id")).distinct()
    kinds = objects.select(F.col("id").alias("in_reply_to"), text_field(F.col("object_json"), "type").alias("parent_kind")).join(
        above.withColumnRenamed("id", "in_reply_to"), "in_reply_to"
    )
    return facts.join(kinds, "in_reply_to", "left")


def thread_reason(parent: str) -> Column:
    """Why a reply to an existing parent (a struct column) is rejected; NULL when it is fine."""
    kind, grandparent = F.col(f"{parent}.kind"), F.col(f"{parent}.parent_kind")
    return F.when((kind == "Note") & F.coalesce(grandparent == "Note", F.lit(False)), DEEP).when(
        ~F.coalesce(kind.isin("Article", "Note"), F.lit(False)), BAD_PARENT
    )


def thread_root(parent: str) -> Column:
    """Root article of a reply to the parent."""
    return F.when(F.col(f"{parent}.kind") == "Article", F.col(f"{parent}.id")).otherwise(
        F.coalesce(f"{parent}.thread_root", f"{parent}.in_reply_to")
    )


def resolve_threads(creates: DataFrame, objects: DataFrame) -> DataFrame:
    """Creates (column in_reply_to) with thread_root, depth, status and reason.

    Two joins at most, because threads are two levels deep; a popular article is a hot key of the first
    join only, which AQE splits.
    """
    wanted = creates.select(F.col("in_reply_to").alias("id")).distinct()
    parents = with_parent_kind(thread_facts(objects, wanted), objects)
    packed = parents.select(F.col("id").alias("in_reply_to"), F.struct(*parents.columns).alias("parent"))
    joined = creates.join(packed, "in_reply_to", "left")
    reason = F.when(F.col("parent").isNull() | F.col("parent.deleted"), NO_PARENT).otherwise(thread_reason("parent"))
    status = F.when(reason.isNull(), 201).when(reason == NO_PARENT, 404).otherwise(400)
    accepted = reason.isNull()
    depth = F.when(F.col("parent.kind") == "Article", 1).otherwise(2)
    return (
        joined.withColumn("reason", reason)
        .withColumn("status", status)
        .withColumn("thread_root", F.when(accepted, thread_root("parent")))
        .withColumn("depth", F.when(accepted, depth))
        .drop("parent")
    )
