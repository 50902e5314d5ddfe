from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from newsloom.operators import objects as ob, ordered, reactions
from newsloom.operators.merge import S, latest_per_key, merge
from newsloom.operators.ordered import with_previous

SCHEMA = "id string, v int, own int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_condition_is_no_update_and_unmatched_rows_survive(spark):
    target = spark.createDataFrame([("a", 1, 7), ("b", None, 8), ("c", 3, 9), (None, 4, 1)], SCHEMA)
    source = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 5), (None, 6)], "id string, v int")
    merged = merge(target, source, {"v": S("v")}, when=S("v") > F.col("v"), insert={"id": F.col("id"), "v": F.col("v")})
    assert rows(merged) == rows(
        spark.createDataFrame([("a", 2, 7), ("b", None, 8), ("c", 3, 9), (None, 4, 1), ("d", 5, None), (None, 6, None)], SCHEMA)
    )


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 5) | st.none(), min_size=1),
    st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 5) | st.none(), min_size=1),
)
def test_merge_is_idempotent_and_keeps_other_columns(spark, old, new):
    target = spark.createDataFrame([(k, v, 1) for k, v in old.items()], SCHEMA)
    source = spark.createDataFrame(list(new.items()), "id string, v int")

    def once(df):
        return merge(df, source, {"v": S("v")}, when=S("v") > F.col("v"), insert={"id": F.col("id"), "v": F.col("v"), "own": F.lit(0)})

    expected = {k: (v, 1) for k, v in old.items()}
    for key, value in new.items():
        if key not in expected:
            expected[key] = (value, 0)
        elif value is not None and expected[key][0] is not None and value > expected[key][0]:
            expected[key] = (value, 1)
    assert rows(once(target)) == sorted([(k, *v) for k, v in expected.items()], key=str)
    assert rows(once(once(target))) == rows(once(target))


def test_latest_per_key_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    latest = latest_per_key(df, "k", [F.desc("id")])
    assert rows(latest) == [(0, 999), (1, 997), (2, 998)]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def _hot_hour(spark):
    """One key has a third of all rows in one hour, many of them at one instant; some rows have no key or value."""
    n = F.col("id")
    return spark.range(6000).select(
        F.when(n % 3 == 0, F.lit("hot")).when(n % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), n % 50)).alias("k"),
        F.when(n % 3 == 0, F.timestamp_seconds(7200 + n % 60)).otherwise(F.timestamp_seconds((n * 7919) % 90000)).alias("t"),
        F.format_string("%05d", n).alias("r"),
        F.when(n % 11 != 0, F.xxhash64(n)).alias("v"),
    )


def test_previous_equals_plain_lag_for_a_hot_key(spark):
    df = _hot_hour(spark)
    plain = rows(df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t", "r"))))
    assert rows(with_previous(df, ["k"], "t", "r", "v", "p")) == plain
    for slot in (1, 7, 64, 5000):
        assert rows(with_previous(df, ["k"], "t", "r", "v", "p", slot=slot)) == plain
    assert with_previous(df.limit(0), ["k"], "t", "r", "v", "p", most=10, slot=5).count() == 0


def test_a_hot_hour_is_spread(spark):
    """The hot key's rows are in many slots and files, none of more rows than a slot holds; its key is in no exchange."""
    placed = ordered.slotted(_hot_hour(spark), ["k", "t", "r"], 64)
    sizes = placed.groupBy("_file", "_slot").agg(F.count("*").alias("n"), F.count_if(F.col("k") == "hot").alias("hot")).collect()
    assert max(r["n"] for r in sizes) <= 64 and sum(r["hot"] > 0 for r in sizes) >= 2000 // 64
    assert len({r["_file"] for r in sizes if r["hot"]}) >= 2
    found = with_previous(_hot_hour(spark), ["k"], "t", "r", "v", "p", slot=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_file" in plan and "hashpartitioning(k#" not in plan


def _objects(spark, rows):
    schema = (
        "id string, source string, published timestamp, updated timestamp, tags array<string>, tags_enriched boolean,"
        "og_enriched boolean, og_enriched_error string, like_count bigint, dislike_count bigint, deleted boolean, object_json string"
    )
    blank = dict(source="hs", published=None, updated=None, tags=["t"], tags_enriched=True, og_enriched=True,
                 og_enriched_error=None, like_count=3, dislike_count=2, deleted=False, object_json="{}")
    names = schema.replace(",", " ").split()[::2]
    from pyspark.sql.types import StructType

    typed = StructType.fromDDL(schema)
    return spark.createDataFrame([tuple((blank | row)[f.name] for f in typed) for row in rows], typed)


def test_upserts_touch_only_their_own_columns(spark):
    from datetime import datetime

    day = [datetime(2026, 1, d) for d in range(1, 9)]
    stored = _objects(spark, [dict(id="a", published=day[0], updated=day[1]), dict(id="s", source="scraped", published=day[0])])
    articles = spark.createDataFrame(
        [("a", "is", day[2], day[3], '{"n":1}'), ("s", "is", day[2], day[3], '{"n":1}'), ("new", "is", day[2], day[3], '{"n":1}')],
        "id string, source string, published timestamp, updated timestamp, object_json string",
    )
    merged = {r["id"]: r.asDict() for r in ob.upsert_articles(stored, articles).collect()}
    owned = dict(tags=["t"], tags_enriched=True, og_enriched=True, like_count=3, dislike_count=2, deleted=False)
    assert {k: merged["a"][k] for k in owned} == owned and merged["a"]["source"] == "is" and merged["a"]["updated"] == day[3]
    assert merged["s"]["source"] == "scraped"  # no stored update time, so nothing counts as newer
    fresh = dict(tags=[], tags_enriched=False, og_enriched=False, like_count=0, dislike_count=0, deleted=False)
    assert {k: merged["new"][k] for k in fresh} == fresh
    scraped = ob.upsert_scraped(stored, articles.drop("source"))
    merged = {r["id"]: r.asDict() for r in scraped.collect()}
    assert merged["a"]["object_json"] == "{}" and merged["s"]["object_json"] == '{"n":1}'
    assert merged["new"]["og_enriched"] and merged["new"]["source"] == "scraped"


def test_counters_and_recency_rules(spark):
    from datetime import datetime

    t = [datetime(2026, 1, d) for d in range(1, 20)]
    stored = _objects(spark, [
        dict(id="a", updated=t[5]), dict(id="b", updated=t[0]), dict(id="gone", updated=t[0], deleted=True),
        dict(id="none", updated=None), dict(id="quiet", updated=t[0]),
    ])
    log = spark.createDataFrame(
        [("1", "Dislike", "u", "a", None, t[3]), ("2", "Like", "u", "b", None, t[9]), ("3", "Like", "v", "gone", None, t[9]),
         ("4", "Like", "v", "none", None, t[9]), ("5", "Like", "v", "quiet", None, t[0]), ("6", "Create", "v", "c1", "b", t[12]),
         ("7", "Create", "v", "c2", "b", t[14]), ("8", "Delete", "v", "c2", None, t[15])],
        "id string, type string, actor string, object_id string, thread_root string, published timestamp",
    ).withColumn("received_at", F.col("published"))
    got = {r["id"]: (r["like_count"], r["dislike_count"], r["updated"])
           for r in reactions.refresh_counters(stored, log, F.lit("2026-01-11").cast("date")).collect()}
    assert got["a"] == (0, 1, t[5])  # a week of dislikes only sets likes to zero; time never moves back
    assert got["b"] == (1, 0, t[12])  # the deleted comment does not count
    assert got["gone"] == (3, 2, t[9]) and got["none"] == (1, 0, None) and got["quiet"] == (3, 2, t[0])
    separate = reactions.apply_last_activity(
        reactions.apply_reaction_counts(stored, reactions.reaction_counts(log, F.lit("2026-01-11").cast("date"))),
        reactions.last_activity(log),
    )
    assert {r["id"]: (r["like_count"], r["dislike_count"], r["updated"]) for r in separate.collect()} == got


def test_one_row_per_key_whatever_the_source_repeats(spark):
    from datetime import datetime

    early, late = datetime(2026, 1, 1), datetime(2026, 1, 2)
    target = _objects(spark, [dict(id="A", source="hs", updated=early), dict(id="S", source="scraped", updated=early)])
    versions = [("A", "hs", early, late, "new"), ("A", "hs", early, early, "old"), ("A", "hs", early, late, "new"), ("B", "hs", early, late, "b2"), ("B", "hs", early, None, "b1")]
    source = spark.createDataFrame(versions, "id string, source string, published timestamp, updated timestamp, object_json string")
    merged = ob.upsert_articles(target, source)
    assert sorted((r.id, r.object_json) for r in merged.filter("id in ('A', 'B')").collect()) == [("A", "new"), ("B", "b2")]
    pages = source.withColumn("id", F.when(F.col("id") == "A", "S").otherwise("T"))
    for result in (ob.upsert_scraped(target, pages), ob.upsert_notes(target, pages)):
        assert sorted(r.id for r in result.collect()) == ["A", "S", "T"]
    deleted = ob.soft_delete(target, spark.createDataFrame([("A", late), ("A", early)], "id string, updated timestamp"))
    assert deleted.count() == 2


def test_only_touched_partitions_are_written(spark, tmp_path):
    """Files of other dates stay as they are; a date whose last row moves away goes."""
    import hashlib
    from datetime import datetime
    from pathlib import Path

    from newsloom.sources import tables

    days = [datetime(2026, 1, d) for d in range(1, 6)]
    root = str(tmp_path)
    tables.write_table(_objects(spark, [dict(id=f"{d.day}{x}", published=d, updated=d) for d in days for x in ("a", "b")] + [
        dict(id="lone", published=datetime(2026, 2, 1), updated=days[0])]), root, "objects")

    def files():
        return {str(f.relative_to(root)): hashlib.md5(f.read_bytes()).hexdigest() for f in Path(root).rglob("*.parquet")}

    before = files()
    source = spark.createDataFrame(
        [("2a", "hs", days[1], days[4], "new"), ("new", "hs", days[3], days[3], "n"), ("lone", "hs", days[3], days[4], "moved")],
        "id string, source string, published timestamp, updated timestamp, object_json string")
    for _ in range(2):
        tables.rewrite_touched(spark, root, "objects", source, ob.upsert_articles)
        after = files()
        changed = {n.split("/")[1] for n in before.keys() ^ after.keys()} | {n.split("/")[1] for n in before.keys() & after.keys() if before[n] != after[n]}
        assert changed == {"published_date=2026-01-02", "published_date=2026-01-04", "published_date=2026-02-01"}
        found = {r.id: r.object_json for r in tables.read_table(spark, root, "objects").collect()}
        assert len(found) == 12 and (found["2a"], found["new"], found["lone"]) == ("new", "n", "moved")
        assert tables.read_table(spark, root, "objects").count() == 12


def test_no_id_of_a_leaving_actor_is_left(spark):
    """Neither in the actor column nor in any document, nested or not, whoever wrote it; other ids stay."""
    import json

    from newsloom.operators import variants

    rows_ = [
        ("1", "users/1", json.dumps({"attributedTo": "users/1", "to": [{"id": "users/2"}, "users/11"]})),
        ("2", "users/2", json.dumps({"object": {"actor": "users/1", "text": "users/1 said"}})),
        ("3", "users/3", "{bad users/1"), ("4", None, None), ("1", "users/11", '"users/1"'),
    ]
    log = spark.createDataFrame(rows_, "id string, actor string, object_json string")
    out = variants.anonymised(log, spark.createDataFrame([("users/1",), ("users/1",)], "actor string"), salt="s").collect()
    assert len(out) == 5
    assert not any('"users/1"' in (r.object_json or "") or r.actor == "users/1" for r in out)
    assert sum('"users/2"' in (r.object_json or "") and '"users/11"' in r.object_json for r in out) == 1
    other = variants.anonymised(log, spark.createDataFrame([("users/1",)], "actor string"), salt="t").collect()
    assert {r.actor for r in out} != {r.actor for r in other}
