import random
from datetime import datetime, timedelta

from pyspark.sql import Row, functions as F

from newsloom.operators import activities as act, objects as ob, reactions
from newsloom.plans import views
from newsloom.sources.tables import read_table, write_table
from newsloom.streaming import jobs, versions
from newsloom.streaming.reactions import CurrentReaction
from tests.test_merge import _objects, rows

SF = "/root/testdata/sf0.001"
AS_OF = "date'2024-01-30'"


def write_parts(df, folder, time, parts=3):
    """Files in time order, one micro-batch each."""
    ranked = df.selectExpr("*", f"ntile({parts}) over (order by {time}) as part")
    for part in range(1, parts + 1):
        ranked.filter(f"part = {part}").drop("part").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    log = views.activities(spark, SF).select("type", "object_id", "published")
    folder, out, mark = (str(tmp_path / n) for n in ("log", "counts", "mark"))
    write_parts(log, folder, "published")
    query = jobs.stream_reaction_counts(stream(spark, folder, log.schema), out, mark)
    query.awaitTermination(120)
    streamed = jobs.current_reaction_counts(spark, out, F.expr(AS_OF))
    assert rows(streamed) == rows(reactions.reaction_counts(log, F.expr(AS_OF)))
    # nothing new: a restart from the checkpoint changes nothing
    jobs.stream_reaction_counts(stream(spark, folder, log.schema), out, mark).awaitTermination(120)
    assert rows(jobs.current_reaction_counts(spark, out, F.expr(AS_OF))) == rows(streamed)


def test_late_rows_are_returned(spark, tmp_path):
    """Whether a row is late is its own matter: a day that has passed for others doesn't make it so."""
    day = datetime(2026, 1, 1)
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = jobs.ACTIVITIES
    batches = [
        [("Like", "a", day + timedelta(days=30), day + timedelta(days=30))], [("Like", "a", day, day + timedelta(days=7))],
        [("Like", "a", day, day + timedelta(days=8)), ("Like", "a", day + timedelta(days=29), day + timedelta(days=29))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    jobs.stream_reaction_counts(stream(spark, folder, schema), out, str(tmp_path / "mark")).awaitTermination(120)
    assert rows(jobs.current_reaction_counts(spark, out, F.lit("2026-02-01").cast("date"), days=60)) == [("a", 3, 0)]
    assert [tuple(r) for r in jobs.late_reactions_of_days(spark, out).collect()] == [batches[2][0]]


def test_counters_fall_without_new_rows(spark, tmp_path):
    """Each move of the window rewrites the objects it changes; days that pass take their reactions along."""
    day = datetime(2026, 1, 1)
    folder, out, root = (str(tmp_path / n) for n in ("log", "out", "tables"))
    objects = [dict(id=i, published=day, like_count=77, dislike_count=0) for i in ("a", "b", "c")] + [dict(id="gone", published=day, deleted=True, like_count=77, dislike_count=0)]
    write_table(_objects(spark, objects), root, "objects")

    def arrive(*batch):
        spark.createDataFrame([(t, o, day + timedelta(days=d), day + timedelta(days=d)) for t, o, d in batch], jobs.ACTIVITIES).coalesce(
            1).write.mode("append").parquet(folder)
        jobs.stream_reaction_counts(stream(spark, folder, jobs.ACTIVITIES), out, str(tmp_path / "mark")).awaitTermination(120)

    def counters(d):
        looked = jobs.slide_counters(spark, root, out, (day + timedelta(days=d)).date())
        return looked, {r["id"]: (r["like_count"], r["dislike_count"]) for r in read_table(spark, root, "objects").collect()}

    arrive(("Like", "a", 0), ("Like", "a", 3), ("Dislike", "b", 3), ("Like", "gone", 3))
    assert counters(3) == (3, {"a": (2, 0), "b": (0, 1), "c": (77, 0), "gone": (77, 0)})
    assert counters(3)[0] == 0
    assert counters(8) == (1, {"a": (1, 0), "b": (0, 1), "c": (77, 0), "gone": (77, 0)})
    arrive(("Like", "b", 9))
    assert counters(9) == (1, {"a": (1, 0), "b": (1, 1), "c": (77, 0), "gone": (77, 0)})
    assert counters(11) == (3, {"a": (0, 0), "b": (1, 0), "c": (77, 0), "gone": (77, 0)})
    assert counters(40) == (1, {"a": (0, 0), "b": (0, 0), "c": (77, 0), "gone": (77, 0)})


def attempted(spark):
    """Reaction requests on few actors and objects, so that most keys meet many of them."""
    return views.activities(spark, SF).filter("type in ('Like', 'Dislike')").select(
        F.col("id").alias("request_id"), F.concat(F.lit("x/"), "id").alias("activity_id"), "type",
        F.concat(F.lit("u"), F.xxhash64("actor") % 3).alias("actor"),
        F.concat(F.lit("o"), F.xxhash64("object_id") % 5).alias("target_id"), F.col("received_at").cast("timestamp").alias("received_at"),
    )


def reactions_in_order(requests):
    state = {}
    for r in sorted(requests, key=lambda r: (r.received_at, r.request_id)):
        if state.get((r.actor, r.target_id), (None,))[0] != r.type:
            state[r.actor, r.target_id] = (r.type, r.activity_id)
    return state


def stored_reactions(spark, path):
    return {(r.actor, r.object_id): (r.reaction_type, r.activity_id) for r in jobs.current_reactions(spark, path).collect()}


def test_streamed_reactions_equal_the_batch(spark, tmp_path):
    attempts = attempted(spark)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(attempts, folder, "received_at")
    jobs.stream_reaction_state(stream(spark, folder, attempts.schema), out, str(tmp_path / "mark")).awaitTermination(120)
    assert stored_reactions(spark, out) == reactions_in_order(attempts.collect())


def test_shuffled_and_replayed_reactions(spark, tmp_path):
    """Any order, every request twice, a restart between all micro-batches: the state is that of the requests in order."""
    attempts = attempted(spark).filter("received_at < timestamp'2024-01-07 12:00:00'")
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    expected = reactions_in_order(attempts.collect())
    assert len(expected) > 10
    for part in range(3):
        for salt in ("a", "b"):
            some = attempts.filter(F.pmod(F.xxhash64("request_id", F.lit(salt)), F.lit(3)) == part)
            some.coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_reaction_state(stream(spark, folder, attempts.schema), out, mark).awaitTermination(120)
    assert stored_reactions(spark, out) == expected
    assert jobs.late_reactions(spark, out).count() == 0


def test_reactions_beyond_what_is_kept_are_returned(spark, tmp_path):
    day = datetime(2026, 1, 1)
    schema = "request_id string, activity_id string, type string, actor string, target_id string, received_at timestamp"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda n, t, d: (f"r{n:03}", f"x{n}", t, "u", "o", day + timedelta(days=d))
    batches = [[row(n, "Like" if n % 2 else "Dislike", n / 10) for n in range(200)], [row(900, "Like", 0.05), row(901, "Dislike", 19.95), row(5, "Like", 0.5)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    jobs.stream_reaction_state(stream(spark, folder, schema), out, str(tmp_path / "mark")).awaitTermination(120)
    assert stored_reactions(spark, out) == {("u", "o"): ("Dislike", "x901")}
    assert sorted(r["request_id"] for r in jobs.late_reactions(spark, out).collect()) == ["r005", "r900"]


def test_a_micro_batch_reads_its_own_keys_only(spark, tmp_path):
    """The plan of the stateful stream has the state store and no file of an earlier version."""
    attempts = attempted(spark)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(attempts, folder, "received_at", 2)
    query = jobs.stream_reaction_state(stream(spark, folder, attempts.schema), out, str(tmp_path / "mark"))
    query.awaitTermination(120)
    plan = query._jsq.explainInternal(False)
    assert "TransformWithState" in plan and "version=" not in plan and "run=" not in plan
    rows_in_state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert rows_in_state > 0


def test_runs_stay_few(spark, tmp_path):
    """Files read grow with the logarithm of the number of versions; folded or not, the content is the same."""
    path, schema = str(tmp_path / "t"), jobs._schema("k string, v bigint")
    expected = {}
    for version in range(40):
        some = [(f"k{version % 7}", version), (f"k{version % 3}", version)]
        expected.update(some)
        versions.write_version(spark.createDataFrame(some, "k string, v bigint").groupBy("k").agg(F.max("v").alias("v")), path, version)
        versions.compact(spark, path, schema, versions.newest("k"), fan=3)
    runs = versions.live_runs(spark, path)
    assert len(runs) <= 3 * 4 and runs[0][0] == 0 and runs[-1] == (39, 39)
    assert all(a[1] + 1 == b[0] for a, b in zip(runs, runs[1:], strict=False))
    read = versions.newest("k")(versions.read_versions(spark, path, schema))
    assert {r["k"]: r["v"] for r in read.collect()} == expected
    # a replay of a folded version changes nothing, one of the newest replaces it
    versions.write_version(spark.createDataFrame([("k0", -1)], "k string, v bigint"), path, 3)
    versions.write_version(spark.createDataFrame([("k0", -1)], "k string, v bigint"), path, 39)
    assert versions.live_runs(spark, path) == runs
    assert {r["k"]: r["v"] for r in versions.read_versions(spark, path, schema, since=38).collect()} == {"k0": -1}
    assert versions.read_versions(spark, path, schema, before=27).filter("version >= 27").count() == 0
    assert versions.read_versions(spark, str(tmp_path / "none"), schema).count() == 0


def test_an_uncommitted_fold_does_not_count(spark, tmp_path):
    path, schema = str(tmp_path / "t"), jobs._schema("k string, v bigint")
    for version in range(3):
        versions.write_version(spark.createDataFrame([("k", version)], schema), path, version)
    (tmp_path / "t" / "run=0-1").mkdir()
    (tmp_path / "t" / "run=0-1" / "part-0.parquet").write_bytes(b"half")
    assert versions.live_runs(spark, path) == [(0, 0), (1, 1), (2, 2)]
    assert versions.read_versions(spark, path, schema).count() == 3


def test_streamed_articles_equal_merging_batch_by_batch(spark, tmp_path):
    day = [datetime(2026, 1, d) for d in range(1, 20)]
    stored = _objects(spark, [dict(id="a", updated=day[4]), dict(id="b", updated=day[9])])
    batches = [
        [("a", "hs", day[0], day[5], "1"), ("a", "hs", day[0], day[6], "2"), ("b", "hs", day[0], day[8], "3"), ("n", "hs", day[0], day[1], "4")],
        [("a", "hs", day[0], day[6], "5"), ("n", "is", day[0], day[7], "6")],
        [("n", "hs", day[0], day[3], "7"), ("b", "hs", day[0], day[12], "8")],
    ]
    expected, folder, out = stored, str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        df = spark.createDataFrame(batch, jobs.ARTICLES)
        df.coalesce(1).write.mode("append").parquet(folder)
        expected = ob.upsert_articles(expected, jobs.latest_per_key(df, "id", [F.desc("updated"), F.desc("object_json")]))
    jobs.stream_upsert_articles(stream(spark, folder, jobs.ARTICLES), out, str(tmp_path / "mark")).awaitTermination(120)
    assert rows(jobs.compacted_articles(stored, out)) == rows(expected)


def test_replayed_requests_make_the_same_ids(spark):
    log = views.requests(spark, SF)
    ids = act.decide(log, views.board(spark, SF), views.likes(spark, SF)).select("request_id", "activity_id", "result_id")
    assert rows(ids) == rows(act.decide(log, views.board(spark, SF), views.likes(spark, SF)).select("request_id", "activity_id", "result_id"))


def test_a_row_dated_ahead_does_not_move_the_watermark(spark, tmp_path):
    day = datetime(2026, 1, 1)
    schema = "type string, object_id string, published timestamp, received_at timestamp"
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    for batch in ([("Like", "a", day + timedelta(days=900), day)], [("Like", "b", day, day)], [("Like", "b", day, day + timedelta(hours=1))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    jobs.stream_reaction_counts(stream(spark, folder, schema), out, str(tmp_path / "mark")).awaitTermination(120)
    expected = [("a", 1, 0), ("b", 2, 0)]
    assert rows(jobs.current_reaction_counts(spark, out, F.lit("2026-01-02").cast("date"))) == expected
    assert rows(reactions.reaction_counts(spark.read.parquet(folder), F.lit("2026-01-02").cast("date"))) == expected


class States:
    """A state handle in memory that counts the calls to its states."""

    def __init__(self):
        self.calls, self.states = 0, {}

    def getValueState(self, name, *schema):
        return self.states.setdefault(name, States.Value(self))

    def getMapState(self, name, *schema):
        return self.states.setdefault(name, States.Map(self))

    class Value:
        def __init__(self, handle):
            self.handle, self.value = handle, None

        def get(self):
            self.handle.calls += 1
            return self.value

        def exists(self):
            return self.get() is not None

        def update(self, value):
            self.handle.calls += 1
            self.value = tuple(value)

    class Map:
        def __init__(self, handle):
            self.handle, self.entries = handle, {}

        def counted(self):
            self.handle.calls += 1
            return self.entries

        def containsKey(self, key):
            return key in self.counted()

        def getValue(self, key):
            return self.counted().get(key)

        def updateValue(self, key, value):
            self.counted()[key] = tuple(value)

        def removeKey(self, key):
            self.counted().pop(key)

        def iterator(self):
            return iter(list(self.counted().items()))


def cell_of(handle, lateness=50):
    processor = CurrentReaction(lateness)
    processor.init(handle)
    return lambda requests: [tuple(r) for r in processor.handleInputRows((0,), iter(requests), None)]


def request(n, pair, at, kind="Like"):
    return Row(cell=0, actor=f"u{pair}", object_id="o", request_id=f"r{n:05}", activity_id=f"x{n}", type=kind, at=at)


def test_a_new_pair_is_one_call_to_the_state():
    """Calls to the state are what the stateful stage takes its time for."""
    handle = States()
    take = cell_of(handle)
    assert len(take([request(n, n, n) for n in range(500)])) == 500
    assert handle.calls <= 510
    # many known ones are read in one go, a few by themselves
    handle.calls = 0
    assert len(take([request(1000 + n, n, 1000 + n, "Dislike") for n in range(500)])) == 500
    assert handle.calls <= 510
    handle.calls = 0
    assert len(take([request(5000, 7, 5000)])) == 1
    assert handle.calls <= 3


def test_pairs_of_a_cell_keep_apart():
    """Pairs with few and with many requests, in any order, in one cell: each is as if alone."""
    for seed in range(30):
        chance = random.Random(seed)
        together, alone = cell_of(States()), [cell_of(States()) for _ in range(6)]
        for batch in range(5):
            requests = [request(100 * batch + n, chance.choice([0, 0, 0, 1, 2, 3, 4, 5]), chance.randrange(40 * batch, 40 * batch + 90),
                                chance.choice(["Like", "Dislike"])) for n in range(chance.choice([2, 40, 90]))]
            apart = [row for p, take in enumerate(alone) for row in take([r for r in requests if r.actor == f"u{p}"])]
            assert sorted(together(requests), key=repr) == sorted(apart, key=repr)
