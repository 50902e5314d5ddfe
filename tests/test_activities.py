import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.operators import activities as act, threads
from newsloom.session import stage
from tests.test_merge import _objects

START = datetime(2026, 1, 1)
REQUEST = "request_id string, type string, actor string, object_id string, object_json string, received_at timestamp"


def stored(spark):
    def article(id, **more):
        return dict(id=id, updated=START, object_json=json.dumps({"type": "Article", "attributedTo": {"name": "hs"}})) | more

    def note(id, owner, parent, root=None, **more):
        doc = {"type": "Note", "attributedTo": owner, "inReplyTo": parent, "content": id, "extra": [1, {"a": None}]}
        if root:
            doc["thread_root"] = root
        return dict(id=id, source="user", updated=START, object_json=json.dumps(doc)) | more

    return [
        article("A"), article("B"), article("gone", deleted=True), article("odd", object_json='{"type":"Event"}'),
        note("n1", "u0", "A", "A"), note("n2", "u1", "n1", "A"), note("n3", "u1", "gone"), note("n4", "u0", "B", deleted=True),
        note("n5", "u2", "missing"), note("n6", "u2", "n4", "B"),
    ]


def key(kind, actor, request):
    import hashlib

    return hashlib.sha256(f"{kind}|{actor}|{request}".encode()).hexdigest()


def simulate(objects, likes, requests):
    """The same rules, one request after the other."""
    state = {o["id"]: dict(doc=json.loads(o["object_json"]), deleted=o.get("deleted", False), updated=o.get("updated")) for o in objects}
    likes = dict(likes)
    results = {}
    for request in sorted(requests, key=lambda r: (r["received_at"], r["request_id"])):
        kind, actor, now = request["type"], request["actor"], request["received_at"]
        payload = json.loads(request["object_json"]) if request["object_json"] else None
        payload = payload if isinstance(payload, dict) else None
        if not kind or not (request["object_id"] or payload):
            results[request["request_id"]] = (400, None)
            continue
        target = request["object_id"] or (payload or {}).get("id")
        found = state.get(target)
        stamp = now.strftime("%Y-%m-%dT%H:%M:%SZ")
        if kind in ("Like", "Dislike"):
            if not target:
                result = (400, None)
            elif not found or found["deleted"]:
                result = (404, None)
            elif likes.get((actor, target)) == kind:
                result = (200, None)
            else:
                likes[actor, target] = kind
                result = (201, target)
        elif kind == "Create":
            parent = state.get((payload or {}).get("inReplyTo"))
            if payload is None or payload.get("type") != "Note" or not payload.get("inReplyTo"):
                result = (400, None)
            elif not parent or parent["deleted"]:
                result = (404, None)
            elif parent["doc"].get("type") not in ("Article", "Note"):
                result = (400, None)
            else:
                root = payload["inReplyTo"]
                if parent["doc"]["type"] == "Note":
                    above = state.get(parent["doc"].get("inReplyTo"))
                    if above and above["doc"].get("type") == "Note":
                        results[request["request_id"]] = (400, None)
                        continue
                    root = parent["doc"].get("thread_root") or parent["doc"].get("inReplyTo")
                new = f"{urls.BASE}/objects/comments/{key(kind, actor, request['request_id'])}"
                doc = payload | {"id": new, "published": stamp, "attributedTo": actor, "thread_root": root}
                state[new] = dict(doc=doc, deleted=False, updated=now)
                result = (201, new)
        elif kind == "Delete":
            if not target:
                result = (400, None)
            elif not found:
                result = (404, None)
            elif found["deleted"]:
                result = (200, None)
            elif found["doc"].get("attributedTo") != actor:
                result = (403, None)
            else:
                found.update(deleted=True, updated=now)
                result = (200, target)
        elif kind == "Update":
            if payload is None or not target:
                result = (400, None)
            elif not found or found["deleted"]:
                result = (404, None)
            elif found["doc"].get("attributedTo") != actor:
                result = (403, None)
            else:
                for field in ("name", "summary", "content"):
                    found["doc"][field] = payload.get(field, found["doc"].get(field))
                found["doc"]["updated"] = stamp
                found["updated"] = now
                result = (200, target)
        else:
            result = (400, None)
        results[request["request_id"]] = result
    return results, state, likes


def random_requests(seed, n):
    rng = random.Random(seed)
    ids = ["A", "B", "gone", "odd", "n1", "n2", "n3", "n4", "n5", "n6", "nowhere"]
    requests, own = [], {}
    for number in range(n):
        kind = rng.choice(["Like", "Dislike", "Like", "Create", "Create", "Create", "Delete", "Update", "Update", "Announce", None])
        actor, request = f"u{rng.randrange(3)}", f"r{number:04d}"
        # a third of all requests goes to one object
        target = "A" if rng.random() < 0.33 else rng.choice(ids + ids[-3:])
        if kind in ("Update", "Delete") and own.get(actor) and rng.random() < 0.5:
            target = rng.choice(own[actor])
        object_id, payload = target, None
        if kind == "Create":
            object_id, payload = None, {"type": rng.choice(["Note"] * 9 + ["Article"]), "content": f"c{number}", "inReplyTo": target}
        elif kind == "Update":
            payload = {"id": target} | {f: rng.choice([f"{f}{number}", None, 7, {"x": 1}]) for f in ("name", "summary", "content") if rng.random() < 0.5}
            object_id = None
        elif rng.random() < 0.2:
            object_id, payload = None, {"id": target}
        if rng.random() < 0.04:
            object_id, payload = None, rng.choice([None, {}, {"type": "Note"}])
        requests.append(dict(
            request_id=request, type=kind, actor=actor, object_id=object_id,
            object_json=None if payload is None else json.dumps(payload),
            received_at=START + timedelta(minutes=number * 3 + rng.randrange(60)),
        ))
        if kind == "Create":
            ids.append(f"{urls.BASE}/objects/comments/{key(kind, actor, request)}")
            own.setdefault(actor, []).append(ids[-1])
    return requests


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_one_request_after_the_other(spark, seed):
    rows = stored(spark)
    requests = random_requests(seed, 250)
    old_likes = {("u0", "A"): "Like", ("u1", "n1"): "Dislike", ("u9", "B"): "Like"}
    objects = _objects(spark, rows)
    likes = spark.createDataFrame(
        [(f"old{n}", *pair, kind, START) for n, (pair, kind) in enumerate(old_likes.items())],
        "activity_id string, actor string, object_id string, reaction_type string, published timestamp",
    )
    batch = spark.createDataFrame([tuple(r.values()) for r in requests], REQUEST)
    outcome = act.apply_activities(batch, objects, likes)
    expected, state, reactions = simulate(rows, old_likes, requests)
    decided = {r.request_id: (r.status, r.result_id) for r in outcome.decided.collect()}
    assert decided == expected
    after = {
        r.id: (json.loads(r.object_json), r.deleted, r.updated)
        for r in outcome.objects.select("id", "object_json", "deleted", F.col("updated").cast("timestamp_ntz").alias("updated")).collect()
    }
    assert after == {id: (o["doc"], o["deleted"], o["updated"]) for id, o in state.items()}
    assert {(r.actor, r.object_id): r.reaction_type for r in outcome.likes.collect()} == reactions
    log = outcome.activities.collect()
    accepted = [r for r in expected.values() if r[1]]
    assert len(log) == len({r.id for r in log}) == len(accepted) and {s for s, _ in accepted} == {200, 201}
    for row in log:
        document = json.loads(row.object_json)
        assert document["type"] == row.type and document["actor"] == row.actor and document["id"] == row.id
        assert document["object"]["id"] == row.object_id if row.type == "Create" else True
    statuses = {s for s, _ in expected.values()}
    assert statuses == {200, 201, 400, 403, 404}


def test_repeated_reaction_keeps_the_first_activity(spark):
    rows = [("r1", "Like", 1), ("r2", "Dislike", 2), ("r3", "Like", 3), ("r4", "Like", 4)]
    batch = spark.createDataFrame([(r, kind, "u", "A", None, START + timedelta(hours=h)) for r, kind, h in rows], REQUEST)
    likes = spark.createDataFrame([], "activity_id string, actor string, object_id string, reaction_type string, published timestamp")
    decided = act.classify_reactions(batch, _objects(spark, stored(spark)), likes)
    assert {r.request_id: (r.status, r.previous) for r in decided.collect()} == {
        "r1": (201, None), "r2": (201, "Like"), "r3": (201, "Dislike"), "r4": (200, "Like"),
    }
    (row,) = act.reaction_state(decided, likes).collect()
    assert (row.reaction_type, row.activity_id) == ("Like", f"{urls.BASE}/activities/likes/{key('Like', 'u', 'r3')}")
    assert act.remove_reactions(act.reaction_state(decided, likes), batch.withColumn("object_id", F.lit("A"))).count() == 0


def test_delete_cases(spark):
    objects = _objects(spark, stored(spark))
    batch = spark.createDataFrame(
        [("ok", "Delete", "u0", "n1", None, START), ("other", "Delete", "u1", "n1", None, START - timedelta(hours=1)),
         ("again", "Delete", "u0", "n4", None, START), ("none", "Delete", "u0", "nonexistent", None, START)], REQUEST)
    got = {r.request_id: (r.status, r.reason) for r in act.classify_deletes(batch, objects).collect()}
    assert got == {"ok": (200, None), "other": (403, "not the owner"), "again": (200, "already_deleted"), "none": (404, "object not found")}


def test_threads(spark):
    creates = spark.createDataFrame([(p,) for p in ["A", "gone", "n1", "n2", "n3", "n5", "n6", "odd", "nope"]], "in_reply_to string")
    got = {r.in_reply_to: (r.status, r.thread_root, r.depth) for r in threads.resolve_threads(creates, _objects(spark, stored(spark))).collect()}
    assert got == {
        "A": (201, "A", 1), "gone": (404, None, None), "n1": (201, "A", 2), "n2": (400, None, None), "n3": (201, "gone", 2),
        "n5": (201, "missing", 2), "n6": (400, None, None), "odd": (400, None, None), "nope": (404, None, None),
    }


def test_repeated_and_replayed_requests(spark):
    """A request delivered twice acts once; a stored note is not made again, so an edit after it stays."""
    objects = _objects(spark, stored(spark))
    likes = spark.createDataFrame([], "activity_id string, actor string, object_id string, reaction_type string, published timestamp")
    made = urls.BASE + "/objects/comments/" + key("Create", "u7", "r1")
    create = ("r1", "Create", "u7", None, json.dumps({"type": "Note", "inReplyTo": "A", "content": "first"}), START + timedelta(hours=1))
    edit = ("r2", "Update", "u7", made, json.dumps({"id": made, "content": "second"}), START + timedelta(hours=2))
    batch = spark.createDataFrame([create, create, (*create[:5], START + timedelta(hours=3)), edit, edit], REQUEST)
    once = act.apply_activities(batch, objects, likes)
    assert sorted(r.status for r in once.decided.collect()) == [200, 201]
    assert once.activities.count() == 2 and once.activities.select("id").distinct().count() == 2
    first = once.objects.filter(F.col("id") == made).collect()
    assert len(first) == 1 and json.loads(first[0].object_json)["content"] == "second"
    again = act.apply_activities(spark.createDataFrame([create], REQUEST), once.objects, once.likes)
    assert [(r.status, r.reason, r.accepted) for r in again.decided.collect()] == [(200, "already_created", False)]
    assert again.activities.count() == 0
    assert again.objects.filter(F.col("id") == made).collect() == first


def test_facts_of_objects_stay_out_of_the_reaction_shuffle(spark):
    """What is written out before reactions are put in order has no looked-up object, and says the same."""
    requests = spark.createDataFrame([
        ("r1", "Like", "u1", "A", None, START), ("r2", "Like", "u1", "A", None, START + timedelta(1)), ("r3", "Like", "u1", "gone", None, START),
        ("r4", "Create", "u1", None, '{"type":"Note","inReplyTo":"n1"}', START), ("r5", "Delete", "u1", "n1", None, START), ("r6", None, "u1", "A", None, START),
        ("r7", "Dislike", "u0", "A", None, START)], REQUEST)
    likes = spark.createDataFrame([("u0", "A", "Dislike")], "actor string, object_id string, reaction_type string")
    written = []

    def keep(df):
        written.append(df.columns)
        return stage(df)

    decided = act.decide(requests, _objects(spark, stored(spark)), likes, keep=keep)
    assert any("attempt" in columns for columns in written) and not any("known" in columns for columns in written)
    found = {r.request_id: (r.status, r.reason, r.thread_root, r.target_kind) for r in decided.collect()}
    assert found == {
        "r1": (201, None, None, "Article"), "r2": (200, "already_reacted", None, "Article"),
        "r3": (404, "target object not found or deleted", None, "Article"), "r4": (201, None, "A", "Note"),
        "r5": (403, "not the owner", None, "Note"), "r6": (400, "missing type or object", None, None),
        "r7": (200, "already_reacted", None, "Article")}
