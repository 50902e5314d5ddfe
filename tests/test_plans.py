"""Shapes of plans that decide how the jobs behave on large, uneven tables."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from newsloom.operators import objects as ob, reactions, threads
from newsloom.operators.merge import S, merge
from newsloom.session import packed, stage


@contextmanager
def settings(spark, **values):
    old = {}
    for name, value in values.items():
        key = name.replace("__", ".")
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_side_of_a_lookup_is_split(spark):
    objects = spark.range(2000).select(
        F.concat(F.lit("o"), "id").alias("id"), F.lit("hs").alias("source"), F.lit("{}").alias("object_json"),
        F.lit(False).alias("deleted"), F.lit(0).alias("like_count"), F.lit(0).alias("dislike_count"),
    )
    # one object is half of all lookups
    ids = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, "o7").otherwise(F.concat(F.lit("o"), F.col("id") % 2000)).alias("id"), F.uuid().alias("payload")
    )
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
    ):
        plan = final_plan(ob.lookup_objects(ids, objects))
    assert "skew=true" in plan


def test_small_merge_does_not_shuffle_the_target(spark, tmp_path):
    spark.range(50000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v")).write.parquet(str(tmp_path / "t"))
    spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit(5).alias("v")).write.parquet(str(tmp_path / "s"))
    target, source = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "s"))
    merged = merge(target, source, {"v": S("v")}, insert={"id": F.col("id"), "v": F.col("v")})
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_counters_are_reduced_before_the_shuffle_and_filters_reach_the_scan(spark, tmp_path):
    log = spark.range(1000).select(
        F.lit("Like").alias("type"), F.col("id").cast("string").alias("object_id"), F.lit(None).cast("string").alias("thread_root"),
        F.lit("x" * 10).alias("object_json"), F.current_timestamp().alias("published"), F.current_timestamp().alias("received_at"),
    )
    log.write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    plan = reactions.reaction_counts(stored, F.current_date())._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange") and "GreaterThanOrEqual(published" in plan
    assert "object_json" not in plan
    plan = reactions.last_activity(stored)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(received_at" in plan and "LeftAnti" in plan


def test_thread_facts_are_read_before_they_are_shuffled(spark):
    objects = spark.createDataFrame(
        [("a", False, '{"type":"Article"}'), ("n", False, '{"type":"Note","inReplyTo":"a"}'), ("x", True, None)], "id string, deleted boolean, object_json string")
    facts = threads.thread_facts(objects, spark.createDataFrame([("n",), ("x",), ("gone",)], "id string"))
    with_kind = threads.with_parent_kind(facts, objects)
    for df, read in ((facts, "from_json"), (with_kind, "get_json_object")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index(read)
    assert sorted((r["id"], r["kind"], r["parent_kind"]) for r in with_kind.collect()) == [("n", "Note", "Article"), ("x", None, None)]


def test_staged_tables_are_packed(spark, tmp_path):
    staged = packed(spark.range(10).selectExpr("id"), "packed")
    assert all(name.endswith(".snappy.parquet") for name in stage(spark.range(10).selectExpr("id")).inputFiles())
    assert staged.inputFiles() and all(name.endswith(".zstd.parquet") for name in staged.inputFiles())
    assert staged.count() == 10
