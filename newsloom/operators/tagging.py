"""Topic tags: the most frequent base forms of an object's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsloom.functions.text import bare_text, unescape, words
from newsloom.operators.merge import latest_per_key
from newsloom.operators.objects import apply_tags, live

TOP_N = 16
MIN_LENGTH = 3
PART_CHARS = 4_000_000
"""Characters of text in a partition: its words, counted and ranked, take some sixty times as many bytes."""

# Words never used as tags.
STOPWORDS = [
    "olla", "että", "joka", "se", "hän", "tämä", "voida", "saada", "tulla", "pitää", "tehdä", "vuosi", "päivä",
    "aika", "koko", "moni", "muu", "kaikki", "jokin", "mikä", "mukaan", "sekä", "kuin", "vaan", "vai", "tai", "koska",
    "suomi", "suomalainen", "uutiset", "uutinen", "viime", "uusi", "ensimmäinen",
]

# Word classes never used as tags (pronouns, conjunctions, adpositions, negations,
# interjections, numerals, adverbs).
REJECTED_CLASSES = [
    "asemosana", "sidesana", "suhdesana", "kieltosana", "huudahdussana", "luku", "seikkasana",
]


def pending_tags(objects: DataFrame, batch: int | None = None) -> DataFrame:
    """Live objects not yet tagged; ``batch`` takes the first ones by id."""
    pending = live(objects).filter(~F.col("tags_enriched")).select("id", "object_json")
    return pending if batch is None else pending.orderBy("id").limit(batch)


def object_texts(objects: DataFrame) -> DataFrame:
    """(id, text): name, summary and content of the document, or of the object an activity wraps."""
    parts = "name string, summary string, content string"
    document = F.from_json("object_json", f"{parts}, object struct<{parts}>")
    read = objects.select("id", document.alias("outer"))
    inner = F.when(F.col("outer.object").isNotNull(), F.col("outer.object")).otherwise(
        F.struct("outer.name", "outer.summary", "outer.content")
    )
    fields = read.select("id", inner.alias("inner"))
    text = F.concat_ws(" ", *[F.nullif(F.col(f"inner.{name}"), F.lit("")) for name in ["name", "summary", "content"]])
    bare = fields.select("id", bare_text(text, collapse=False).alias("text"))
    return bare.select("id", unescape(F.col("text")).alias("text"))


def text_parts(texts: DataFrame, column: str = "text", chars: int = PART_CHARS) -> int:
    """Partitions (two at least) in which the texts of ``column`` lie with about ``chars`` characters each."""
    return 2 + (texts.agg(F.sum(F.length(column))).first()[0] or 0) // chars


def lemmas(texts: DataFrame, lexicon: DataFrame | None = None, stopwords=STOPWORDS, parts: int | None = None) -> DataFrame:
    """(id, lemma, n, first): accepted base forms of each text with their count and first position.

    One shuffle on the id; counting and ranking reuse that partitioning, because a text is one row and
    its words never leave its partition. There are as many partitions as the texts are long, so that a task's memory
    does not follow the table; ``parts`` is their number where the caller has it at less cost than :func:`text_parts`.
    ``lexicon`` (token, baseform, class) maps tokens to base forms and drops unknown tokens; without it every token is
    its own base form.
    """
    by_object = texts.repartition(text_parts(texts) if parts is None else parts, F.col("id"))
    tokens = by_object.select("id", F.posexplode(words(F.col("text"))).alias("position", "token"))

    def accepted(df: DataFrame, form: str) -> DataFrame:
        shaped = df.withColumn("lemma", F.btrim(F.lower(form), F.lit("-")))
        return shaped.filter((F.length("lemma") >= MIN_LENGTH) & ~F.col("lemma").isin(*stopwords))

    if lexicon is None:
        counted = accepted(tokens, "token").groupBy("id", "lemma")
        return counted.agg(F.count("*").alias("n"), F.min("position").alias("first"))
    # repeats are counted before the join, so a common word is one row per object
    distinct = tokens.groupBy("id", "token").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    known = accepted(
        latest_per_key(lexicon, "token", [F.col("baseform"), F.col("class")]).filter(
            ~F.coalesce(F.col("class"), F.lit("")).isin(*REJECTED_CLASSES)
        ),
        "baseform",
    ).select("token", "lemma")
    return (
        distinct.join(known, "token")
        .groupBy("id", "lemma")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )


def ranked_tags(counts: DataFrame, n: int = TOP_N) -> DataFrame:
    """(id, lemma, n, place): the n most frequent lemmas; ties go to the one that appears first."""
    best = Window.partitionBy("id").orderBy(F.desc("n"), F.asc("first"))
    return (
        counts.withColumn("place", F.row_number().over(best).cast("bigint"))
        .filter(F.col("place") <= n)
        .select("id", "lemma", "n", "place")
    )


def top_tags(counts: DataFrame, n: int = TOP_N) -> DataFrame:
    """(id, tags): the ranked lemmas as an array of at most n."""
    pairs = F.sort_array(F.collect_list(F.struct("place", "lemma")))
    return ranked_tags(counts, n).groupBy("id").agg(F.transform(pairs, lambda pair: pair["lemma"]).alias("tags"))


def tag_objects(
    objects: DataFrame, lexicon: DataFrame | None = None, batch: int | None = None, n: int = TOP_N
) -> DataFrame:
    """(id, tags) for every pending object; a text without usable words gives an empty list."""
    pending = pending_tags(objects, batch)
    # a document is at least as long as its text, and need not be read for it
    tags = top_tags(lemmas(object_texts(pending), lexicon, parts=text_parts(pending, "object_json")), n)
    return pending.select("id").join(tags, "id", "left")


def enrich_tags(objects: DataFrame, lexicon: DataFrame | None = None, batch: int | None = None) -> DataFrame:
    """Objects with the tags of all pending rows filled in."""
    return apply_tags(objects, tag_objects(objects, lexicon, batch))


def with_likes_tag(objects: DataFrame) -> DataFrame:
    """Keep exactly one ``likes:N`` tag per object, the current count."""
    others = F.filter("tags", lambda tag: ~tag.startswith("likes:"))
    return objects.withColumn(
        "tags", F.concat(others, F.array(F.concat(F.lit("likes:"), F.col("like_count").cast("string"))))
    )
