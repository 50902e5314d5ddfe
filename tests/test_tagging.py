import json
import re

from pyspark.sql import functions as F

from newsloom.functions.text import WORD
from newsloom.operators import tagging
from tests.test_merge import _objects


def ranked(forms):
    """Sixteen forms by how often they occur, and then by where they occur first."""
    places = {}
    for place, form in enumerate(forms):
        places.setdefault(form, []).append(place)
    return sorted(places, key=lambda form: (-len(places[form]), places[form][0]))[:16]


def usable(forms):
    return [form for form in (f.lower().strip("-") for f in forms) if len(form) > 2 and form not in tagging.STOPWORDS]


def test_tags_of_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    tokens = {r.id: re.findall(WORD, r.text) for r in docs.collect()}
    found = {r.id: r.tags for r in tagging.top_tags(tagging.lemmas(docs)).collect()}
    assert found == {id: ranked(forms) for id, forms in ((id, usable(t)) for id, t in tokens.items()) if forms}
    classes = ["nimisana", "sidesana", None, "seikkasana", "teonsana"]
    known = sorted({t for some in tokens.values() for t in some})
    entries = [(t, t[:4].upper(), classes[n % 5]) for n, t in enumerate(known) if n % 3]
    found = {
        r.id: r.tags
        for r in tagging.top_tags(tagging.lemmas(docs, spark.createDataFrame(entries, "token string, baseform string, class string"))).collect()
    }
    base = {t: form for t, form, kind in entries if kind not in tagging.REJECTED_CLASSES}
    expected = {id: ranked(usable([base[t] for t in some if t in base])) for id, some in tokens.items()}
    assert found == {id: tags for id, tags in expected.items() if tags}


def test_one_shuffle_without_lexicon(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    plan = tagging.top_tags(tagging.lemmas(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pending_rows_are_always_marked_and_wrapped_objects_unwrapped(spark):
    def document(**fields):
        return json.dumps(fields)

    objects = _objects(spark, [
        dict(id="a", tags_enriched=False, tags=[], object_json=document(name="Talo talo", summary="<b>kissa</b>", content="")),
        dict(id="b", tags_enriched=False, tags=["old"], object_json=document(object={"content": "koira &amp; hevonen"}, name="ulko")),
        dict(id="c", tags_enriched=False, tags=["old"], object_json="{bad"),
        dict(id="d", tags_enriched=True, tags=["old"], object_json=document(name="lintu")),
        dict(id="e", tags_enriched=False, deleted=True, tags=["old"], object_json=document(name="lintu")),
        dict(id="f", tags_enriched=False, tags=["old"], object_json=document(object="viite", name="lintu suomi")),
    ])
    got = {r.id: (r.tags, r.tags_enriched) for r in tagging.enrich_tags(objects).collect()}
    assert got == {
        "a": (["talo", "kissa"], True), "b": (["koira", "hevonen"], True), "c": ([], True), "d": (["old"], True),
        "e": (["old"], False), "f": (["lintu"], True),
    }
    assert [r.id for r in tagging.pending_tags(objects, 2).collect()] == ["a", "b"]
    liked = tagging.with_likes_tag(tagging.with_likes_tag(objects)).filter("id = 'd'").first()
    assert liked.tags == ["old", "likes:3"]


def test_partitions_follow_the_length_of_the_texts(spark):
    """Where a table is larger, there are more tasks and not larger ones; repeated and NULL ids count as before."""
    docs = spark.createDataFrame([("a", "sana " * 40), ("a", "sana toinen"), (None, "kolmas"), ("b", None)], "id string, text string")
    assert tagging.text_parts(docs, chars=10) == 23 and tagging.text_parts(docs) == 2 and tagging.text_parts(docs.limit(0)) == 2
    found = sorted(tuple(r) for r in tagging.lemmas(docs, parts=5).fillna("-").collect())
    assert found == sorted(tuple(r) for r in tagging.lemmas(docs).fillna("-").collect())
    assert found == [("-", "kolmas", 1, 0), ("a", "sana", 41, 0), ("a", "toinen", 1, 1)]
    long = spark.range(1600).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("sana "), 5000).alias("text"))
    plan = tagging.lemmas(long)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and ", 12)" in plan and "REPARTITION_BY_NUM" in plan
