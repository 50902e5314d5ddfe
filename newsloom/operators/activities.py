"""Applying a batch of user requests: likes, dislikes, comments, edits and deletions.

A request is (request_id, type, actor, object_id, object_json, received_at). Requests act in the order of
(received_at, request_id): a comment can be answered, liked, edited or deleted later in the same batch, and
nothing reaches an object after its deletion. Because threads are two levels deep this takes three joins,
whatever the size of the batch, and no loop over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.documents import keys, null_value, parsed, text_field, with_fields
from newsloom.functions.times import rfc3339
from newsloom.functions.urls import BASE, activity_id, comment_id
from newsloom.operators.merge import latest_per_key
from newsloom.operators.objects import apply_updates, soft_delete, upsert_notes
from newsloom.operators.ordered import hottest, with_previous
from newsloom.operators.threads import NO_PARENT, thread_facts, thread_reason, thread_root, with_parent_kind
from newsloom.session import packed

REACTIONS = ("Like", "Dislike")
EDITABLE = ("name", "summary", "content")

Stage = Callable[[DataFrame], DataFrame]


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) == ""


def _moment() -> Column:
    """Place of a request in the order of the batch."""
    return F.struct("received_at", "request_id")


def _is(kind: str) -> Column:
    return F.coalesce(F.col("type") == kind, F.lit(False))


def dispatch(requests: DataFrame) -> DataFrame:
    """Requests with their target, the id to look up and, for malformed ones, the reason."""
    payload = F.nullif(F.nullif(F.col("object_json"), F.lit("")), F.lit("{}"))
    read = requests.withColumn("object_json", payload).withColumn("is_object", F.json_object_keys(payload).isNotNull())
    read = read.withColumn(
        "target_id",
        F.nullif(F.coalesce(F.nullif(F.col("object_id"), F.lit("")), text_field(F.col("object_json"), "id")), F.lit("")),
    ).withColumn("in_reply_to", F.when(_is("Create"), F.nullif(text_field(F.col("object_json"), "inReplyTo"), F.lit(""))))
    reaction = F.coalesce(F.col("type").isin(*REACTIONS), F.lit(False))
    reason = (
        F.when(_blank(F.col("type")) | (_blank(F.col("object_id")) & F.col("object_json").isNull()), "missing type or object")
        .when(reaction & F.col("target_id").isNull(), "missing object id for reaction")
        .when((_is("Create") | _is("Update")) & ~F.col("is_object"), "object must be a JSON object")
        .when(_is("Create") & F.coalesce(text_field(F.col("object_json"), "type") != "Note", F.lit(True)), "only notes can be created")
        .when(_is("Create") & F.col("in_reply_to").isNull(), "inReplyTo is required")
        .when((_is("Delete") | _is("Update")) & F.col("target_id").isNull(), "missing object id")
        .when(~F.col("type").isin(*REACTIONS, "Create", "Delete", "Update"), "activity type is not supported")
    )
    lookup = F.when(_is("Create"), F.col("in_reply_to")).otherwise(F.col("target_id"))
    return (
        read.withColumn("malformed", reason)
        .withColumn("lookup_id", F.when(F.col("malformed").isNull(), lookup))
        .withColumn("moment", _moment())
        .drop("is_object")
    )


def _with_deletion(known: DataFrame, deletes: DataFrame) -> DataFrame:
    """Known objects with ``deleted_at``: the moment of the first deletion by the owner in this batch.

    Known ids are unique, so an object with very many deletions is skewed on one side of an inner join, which
    AQE splits, and the minimum is reduced before its shuffle.
    """
    facts = known.select(F.col("id").alias("lookup_id"), F.col("owner").alias("actor"), "deleted", "created_at")
    own = deletes.select("lookup_id", "actor", "moment").join(facts, ["lookup_id", "actor"])
    valid = own.filter(~F.col("deleted") & (F.col("created_at").isNull() | (F.col("created_at") < F.col("moment"))))
    first = valid.groupBy(F.col("lookup_id").alias("id")).agg(F.min("moment").alias("deleted_at"))
    return known.join(first, "id", "left")


def _alive(known: str) -> Column:
    """The looked-up object exists and is not deleted at the moment of the request."""
    return _exists(known) & ~_gone(known)


def _exists(known: str) -> Column:
    created = F.col(f"{known}.created_at")
    return F.col(known).isNotNull() & (created.isNull() | (created < F.col("moment")))


def _gone(known: str) -> Column:
    return F.col(f"{known}.deleted") | F.coalesce(F.col(f"{known}.deleted_at") < F.col("moment"), F.lit(False))


def _packed(known: DataFrame) -> DataFrame:
    return known.select(F.col("id").alias("lookup_id"), F.struct(*known.columns).alias("known"))


def _made_id(base: str) -> Column:
    """Id of the note a Create makes; the same request always makes the same one."""
    return comment_id(F.col("type"), F.col("actor"), F.col("request_id"), base)


def _new_notes(creates: DataFrame, known: DataFrame, base: str) -> DataFrame:
    """Notes made by the accepted replies to known objects, as known objects themselves."""
    accepted = creates.join(_packed(known), "lookup_id").filter(_alive("known") & thread_reason("known").isNull())
    return accepted.select(
        F.col("in_reply_to"),
        _made_id(base).alias("id"),
        F.lit(False).alias("deleted"),
        F.lit("Note").alias("kind"),
        F.col("actor").alias("owner"),
        thread_root("known").alias("thread_root"),
        F.col("known.kind").alias("parent_kind"),
        F.col("moment").alias("created_at"),
    )


def known_objects(
    checked: DataFrame, objects: DataFrame, base: str = BASE, keep: Stage = packed
) -> tuple[DataFrame, DataFrame]:
    """The stored objects the batch refers to; and with those the batch itself makes, all with creation and deletion moments.

    Each level is written out once (``keep``), so the objects table is not read again per level.
    """
    valid = checked.filter("malformed is null")
    deletes, creates = valid.filter(_is("Delete")), valid.filter(_is("Create"))
    own = creates.select(_made_id(base).alias("id"))
    wanted = valid.select(F.col("lookup_id").alias("id")).unionByName(own).distinct()
    facts = with_parent_kind(keep(thread_facts(objects, wanted)), objects)
    moment = checked.schema["moment"].dataType
    stored = keep(facts.withColumn("created_at", F.lit(None).cast(moment)))
    level = known = _with_deletion(stored, deletes)
    # First-level comments, then their replies; replies to those are always rejected, so two rounds are all.
    # A replayed batch finds its notes stored already: the stored row counts.
    for _ in range(2):
        made = _new_notes(creates, level, base).join(stored.select("id"), "id", "left_anti")
        level = _with_deletion(keep(made), deletes)
        known = known.unionByName(level)
    return stored, known


def _with_previous_reaction(rows: DataFrame, likes: DataFrame, most: int) -> DataFrame:
    """Rows with ``previous``: for a reaction attempt, the actor's reaction to the object just before.

    Other rows go along under keys of their own, so one pass serves all.
    """
    keyed = rows.withColumns({
        "_by": F.when(F.col("attempt"), F.col("actor")), "_on": F.when(F.col("attempt"), F.col("target_id")).otherwise(F.col("request_id"))})
    ordered = with_previous(keyed, ["_by", "_on"], "received_at", "request_id", "type", "before", most)
    stored = likes.select(F.col("actor").alias("_by"), F.col("object_id").alias("_on"), F.col("reaction_type").alias("stored_reaction"))
    return ordered.join(stored, ["_by", "_on"], "left").withColumn(
        "previous", F.when(F.col("attempt"), F.coalesce("before", "stored_reaction"))).drop("_by", "_on")


def decide(
    requests: DataFrame, objects: DataFrame, likes: DataFrame, base: str = BASE, keep: Stage = packed
) -> DataFrame:
    """Requests with status, reason, accepted and, for accepted ones, the ids they produce.

    status: 201 created, 200 done or nothing to do, 400 malformed, 403 not the owner, 404 no such object.
    A request id delivered several times counts once, as it first arrived. A Create whose note is stored already
    was handled before: 200, and the note stays as it is now. ``keep`` writes intermediate results out (see
    session.stage).
    """
    once = latest_per_key(requests, "request_id", [F.col(c) for c in ["received_at", *sorted(set(requests.columns) - {"received_at", "request_id"})]])
    checked = keep(dispatch(once))
    stored, known = known_objects(checked, objects, base, keep)
    facts = keep(known)
    made = F.when(F.col("malformed").isNull() & _is("Create"), _made_id(base))
    handled = stored.select(F.col("id").alias("made_id"), F.lit(True).alias("stored"))
    seen = checked.join(_packed(facts), "lookup_id", "left").withColumn("made_id", made).join(handled, "made_id", "left").drop("made_id")
    ok = F.col("malformed").isNull()
    reaction = F.coalesce(F.col("type").isin(*REACTIONS), F.lit(False))
    attempt = F.coalesce(ok & reaction & _alive("known"), F.lit(False))
    owner = F.coalesce(F.col("known.owner") == F.col("actor"), F.lit(False))
    reason = (
        F.when(~ok, F.col("malformed"))
        .when(reaction & ~attempt, "target object not found or deleted")
        .when(_is("Create") & F.coalesce("stored", F.lit(False)), "already_created")
        .when(_is("Create") & ~_alive("known"), NO_PARENT)
        .when(_is("Create"), thread_reason("known"))
        .when(_is("Delete") & ~_exists("known"), "object not found")
        .when(_is("Delete") & _gone("known"), "already_deleted")
        .when(_is("Update") & ~_alive("known"), "object not found or deleted")
        .when((_is("Delete") | _is("Update")) & ~owner, "not the owner")
    )
    # all but the reaction before is known here, so the facts of the objects need not go through its shuffle
    flagged = keep(seen.select(
        "request_id", "type", "actor", "object_id", "target_id", "object_json", "received_at", "in_reply_to",
        attempt.alias("attempt"), reason.alias("_reason"), F.when(_is("Create"), thread_root("known")).alias("_root"),
        F.col("known.kind").alias("target_kind"),
    ))
    most = hottest(checked.filter(ok & reaction), ["actor", "lookup_id"])
    decided = _with_previous_reaction(flagged, likes, most)
    repeated = F.col("attempt") & F.coalesce(F.col("previous") == F.col("type"), F.lit(False))
    reason = F.when(repeated, "already_reacted").otherwise(F.col("_reason"))
    accepted = F.col("reason").isNull()
    status = (
        F.when(accepted & (reaction | _is("Create")), 201)
        .when(accepted | F.col("reason").isin("already_reacted", "already_deleted", "already_created"), 200)
        .when(F.col("reason") == "not the owner", 403)
        .when(F.col("reason").contains("not found"), 404)
        .otherwise(400)
    )
    kind, actor, request = F.col("type"), F.col("actor"), F.col("request_id")
    return (
        decided.withColumn("reason", reason)
        .withColumn("accepted", accepted)
        .withColumn("status", status)
        .withColumn("activity_id", F.when(accepted, activity_id(kind, actor, request, base)))
        .withColumn(
            "result_id",
            F.when(accepted, F.when(_is("Create"), comment_id(kind, actor, request, base)).otherwise(F.col("target_id"))),
        )
        .withColumn("thread_root", F.when(accepted, F.col("_root")))
        .select(
            "request_id", "type", "actor", "object_id", "target_id", "object_json", "received_at", "status", "reason",
            "accepted", "previous", "activity_id", "result_id", "in_reply_to", "thread_root", "target_kind",
        )
    )


def classify_reactions(requests: DataFrame, objects: DataFrame, likes: DataFrame, base: str = BASE) -> DataFrame:
    """Decisions on likes and dislikes."""
    return decide(requests, objects, likes, base).filter(F.col("type").isin(*REACTIONS))


def _no_likes(requests: DataFrame) -> DataFrame:
    return requests.sparkSession.createDataFrame([], "actor string, object_id string, reaction_type string")


def _classify(kind: str, requests: DataFrame, objects: DataFrame, base: str) -> DataFrame:
    others = requests.filter(~F.coalesce(F.col("type").isin(*REACTIONS), F.lit(False)))
    return decide(others, objects, _no_likes(requests), base).filter(_is(kind))


def classify_creates(requests: DataFrame, objects: DataFrame, base: str = BASE) -> DataFrame:
    """Decisions on comments."""
    return _classify("Create", requests, objects, base)


def classify_deletes(requests: DataFrame, objects: DataFrame, base: str = BASE) -> DataFrame:
    """Decisions on deletions."""
    return _classify("Delete", requests, objects, base)


def classify_updates(requests: DataFrame, objects: DataFrame, base: str = BASE) -> DataFrame:
    """Decisions on edits."""
    return _classify("Update", requests, objects, base)


def reaction_state(decided: DataFrame, likes: DataFrame) -> DataFrame:
    """Current reactions after the batch: one row per actor and object, the last accepted type.

    A repeated reaction of the same type is not accepted, so it keeps the earlier activity and time.
    """
    accepted = decided.filter(F.col("accepted") & F.col("type").isin(*REACTIONS))
    newest = accepted.groupBy("actor", F.col("target_id").alias("object_id")).agg(
        F.max_by(F.struct("activity_id", "type", "received_at"), _moment()).alias("last")
    )
    kind = likes.schema["published"].dataType
    changed = newest.select(
        F.col("last.activity_id").alias("activity_id"), "actor", "object_id",
        F.col("last.type").alias("reaction_type"), F.col("last.received_at").cast(kind).alias("published"),
    )
    columns = changed.columns
    return likes.join(newest.select("actor", "object_id"), ["actor", "object_id"], "left_anti").select(*columns).unionByName(changed)


def remove_reactions(likes: DataFrame, removals: DataFrame) -> DataFrame:
    """Reactions without those of the given (actor, object_id) pairs."""
    return likes.join(removals.select("actor", "object_id").distinct(), ["actor", "object_id"], "left_anti")


def with_note_documents(decided: DataFrame, out: str) -> DataFrame:
    """Add the stored document of each created note: the payload, stamped."""
    stamps = {
        "id": F.col("result_id"),
        "published": rfc3339(F.col("received_at")),
        "attributedTo": F.col("actor"),
        "thread_root": F.col("thread_root"),
    }
    return with_fields(decided, "object_json", stamps, out)


def created_notes(decided: DataFrame) -> DataFrame:
    """Rows for upsert_notes."""
    return with_note_documents(decided.filter(F.col("accepted") & _is("Create")), "document").select(
        F.col("result_id").alias("id"),
        F.col("received_at").alias("published"),
        F.col("received_at").alias("updated"),
        F.col("document").alias("object_json"),
    )


def folded_edits(decided: DataFrame) -> DataFrame:
    """One row per edited object: for every field the last value supplied in the batch, and the last edit time."""
    edits = decided.filter(F.col("accepted") & _is("Update")).withColumn("fields", parsed(F.col("object_json")))
    aggregates = []
    for name in EDITABLE:
        supplied = F.map_contains_key("fields", name)
        value = F.when(supplied, F.struct(_moment().alias("at"), F.to_json(F.struct(F.col("fields")[name].alias("v")), {"ignoreNullFields": "false"}).alias("json")))
        aggregates.append(F.max(value)["json"].alias(name))
    return edits.groupBy(F.col("target_id").alias("id")).agg(F.max("received_at").alias("updated"), *aggregates)


def edited_documents(decided: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows for apply_updates: supplied fields overwritten, the others as they were (null when they were absent)."""
    joined = folded_edits(decided).join(objects.select("id", "object_json"), "id").withColumn(
        "present", keys(F.col("object_json"))
    )
    fields = {
        name: F.coalesce(
            F.variant_get(F.try_parse_json(F.col(name)), "$.v", "variant"),
            F.when(~F.array_contains("present", name), null_value()),
        )
        for name in EDITABLE
    }
    fields["updated"] = rfc3339(F.col("updated"))
    return with_fields(joined, "object_json", fields).select("id", "updated", "object_json")


def deleted_ids(decided: DataFrame) -> DataFrame:
    """Rows for soft_delete."""
    return decided.filter(F.col("accepted") & _is("Delete")).groupBy(F.col("target_id").alias("id")).agg(
        F.min("received_at").alias("updated")
    )


def activity_rows(decided: DataFrame) -> DataFrame:
    """Event-log rows of the accepted requests."""
    stamped = rfc3339(F.col("received_at"))
    payload = (
        F.when(_is("Create"), F.try_parse_json(F.col("note")))
        .when(F.col("object_json").isNotNull() & ~F.col("type").isin(*REACTIONS), F.try_parse_json(F.col("object_json")))
        .otherwise(F.col("target_id").cast("variant"))
    )
    document = F.to_json(
        F.struct(
            F.col("type").alias("type"), F.col("activity_id").alias("id"), F.col("actor").alias("actor"),
            payload.alias("object"), stamped.alias("published"),
        )
    )
    object_type = (
        F.when(F.col("type").isin(*REACTIONS), F.coalesce("target_kind", F.lit("Article")))
        .when(_is("Delete"), F.coalesce("target_kind", F.lit("Note")))
        .otherwise("Note")
    )
    return with_note_documents(decided.filter("accepted"), "note").select(
        F.col("activity_id").alias("id"),
        "type",
        "actor",
        F.col("result_id").alias("object_id"),
        object_type.alias("object_type"),
        document.alias("object_json"),
        F.lit(None).cast("string").alias("target_id"),
        F.when(_is("Create"), F.col("in_reply_to")).alias("in_reply_to"),
        "thread_root",
        F.col("received_at").alias("published"),
        "received_at",
    )


@dataclass
class Outcome:
    """Results of a batch: decisions, new log rows and the new state of the tables."""

    decided: DataFrame
    activities: DataFrame
    objects: DataFrame
    likes: DataFrame


def apply_activities(
    requests: DataFrame, objects: DataFrame, likes: DataFrame, base: str = BASE, keep: Stage = packed
) -> Outcome:
    """Apply a batch of requests to objects and reactions."""
    return applied(keep(decide(requests, objects, likes, base, keep)), objects, likes)


def applied(decided: DataFrame, objects: DataFrame, likes: DataFrame) -> Outcome:
    """The outcome of decisions that are written out."""
    with_notes = upsert_notes(objects, created_notes(decided))
    edited = apply_updates(with_notes, edited_documents(decided, with_notes))
    return Outcome(decided, activity_rows(decided), soft_delete(edited, deleted_ids(decided)), reaction_state(decided, likes))
