"""The tables of the model (objects, activities, likes, ...) derived from the given test tables.

Everything is computed by Spark from whole tables, so the work of a query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.text import words
from newsloom.functions.urls import scraped_id
from newsloom.operators.tagging import lemmas, top_tags

ORIGIN = "timestamp_ntz'2024-01-01 00:00:00'"
NOW = "timestamp_ntz'2024-02-01 00:00:00'"
AS_OF = "date'2024-01-30'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream: a folder of files, or one file of the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def dealt_out(df: DataFrame) -> DataFrame:
    """Rows in as many partitions as a shuffle has: the given files have one row group each, which one task reads."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def now() -> Column:
    return F.expr(NOW)


def as_of() -> Column:
    return F.expr(AS_OF)


def minutes_after_origin(minutes: Column) -> Column:
    return F.expr(ORIGIN) + F.make_dt_interval(mins=minutes.cast("int"))


def _size(spark: SparkSession, sf_dir: str, name: str, column: str) -> int:
    """One more than the largest value, so that what points into a table reaches all of it at every scale."""
    return (table(spark, sf_dir, name).agg(F.max(column)).first()[0] or 0) + 1


def _doc(number: Column) -> Column:
    return F.concat(F.lit("doc/"), number.cast("string"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def activities(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Event log: clicks are likes, errors dislikes, signups comments, views edits, purchases deletions."""
    kind = (
        F.when(F.col("event_type") == "click", "Like")
        .when(F.col("event_type") == "error", "Dislike")
        .when(F.col("event_type") == "signup", "Create")
        .when(F.col("event_type") == "view", "Update")
        .otherwise("Delete")
    )
    event = F.col("event_id")
    article = _doc((F.col("user_id") * 1009 + _k() * 31 + event) % _size(spark, sf_dir, "documents", "doc_id"))
    target = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("comments/"), event.cast("string")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("comments/"), (event - 1 - event % 7).cast("string")))
        .otherwise(article)
    )
    return (stream_table if stream else table)(spark, sf_dir, "events").select(
        F.concat(F.lit("act/"), event.cast("string")).alias("id"),
        kind.alias("type"),
        F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("actor"),
        target.alias("object_id"),
        F.when(F.col("event_type") == "signup", article).alias("thread_root"),
        F.col("ts").alias("published"),
        (F.col("ts") + F.expr("interval 2 seconds")).alias("received_at"),
    )


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current reaction per actor and object: the latest Like or Dislike of the log."""
    reactions = activities(spark, sf_dir).filter(F.col("type").isin("Like", "Dislike"))
    order = F.struct("published", "id")
    return reactions.groupBy("actor", "object_id").agg(
        F.max_by("id", order).alias("activity_id"),
        F.max_by("type", order).alias("reaction_type"),
        F.max("published").alias("published"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(_doc(F.col("doc_id")).alias("id"), "text")


def object_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tags) of every document, identity lexicon, no stopwords."""
    return top_tags(lemmas(texts(spark, sf_dir), stopwords=[""]))


def _article(id: Column, name: Column, summary: Column, published: Column, source: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("https://www.w3.org/ns/activitystreams").alias("@context"),
            F.lit("Article").alias("type"),
            id.alias("id"),
            F.concat(F.lit("https://"), source, F.lit(".example/"), id).alias("url"),
            name.alias("name"),
            summary.alias("summary"),
            F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
            F.struct(F.lit("Organization").alias("type"), source.alias("name")).alias("attributedTo"),
        )
    )


def objects(spark: SparkSession, sf_dir: str, tags: bool = False) -> DataFrame:
    """Articles from documents: the opening words are the name, the whole text is the summary.

    Every 29th has no stored document. ``tags`` fills in the tags column.
    """
    number = F.col("doc_id")
    published = minutes_after_origin(number * 37 % 43200)
    id = _doc(number)
    name = F.substring("text", 1, 60)
    base = table(spark, sf_dir, "documents").select(
        id.alias("id"),
        "source",
        published.alias("published"),
        F.when(number % 5 != 0, minutes_after_origin(number * 37 % 43200 + number % 1000)).alias("updated"),
        (number % 4 != 0).alias("tags_enriched"),
        (number % 3 == 0).alias("og_enriched"),
        F.lit(None).cast("string").alias("og_enriched_error"),
        (number % 7).alias("like_count"),
        (number % 3).alias("dislike_count"),
        (number % 17 == 0).alias("deleted"),
        F.when(number % 29 != 0, _article(id, name, F.col("text"), published, F.col("source"))).alias("object_json"),
    )
    empty = F.array().cast("array<string>")
    if not tags:
        return base.withColumn("tags", empty)
    return base.join(object_tags(spark, sf_dir), "id", "left").withColumn("tags", F.coalesce("tags", empty))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: turn 0 is an article, each later turn a note replying to the one before."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")

    def at(number: Column) -> Column:
        return F.concat(F.lit("conv/"), conv, F.lit("/"), number.cast("string"))

    author = F.concat(F.lit("users/"), ((F.col("conv_id") + turn) % _size(spark, sf_dir, "events", "user_id")).cast("string"))
    article = F.to_json(
        F.struct(
            F.lit("Article").alias("type"),
            at(turn).alias("id"),
            F.col("text").alias("name"),
            F.struct(F.lit("Organization").alias("type"), F.col("role").alias("name")).alias("attributedTo"),
        )
    )
    note = F.to_json(
        F.struct(
            F.lit("Note").alias("type"),
            at(turn).alias("id"),
            F.col("text").alias("content"),
            author.alias("attributedTo"),
            at(turn - 1).alias("inReplyTo"),
            F.when(turn > 1, at(F.lit(0))).alias("thread_root"),
        )
    )
    published = minutes_after_origin(F.col("conv_id") * 11 % 20000 + turn)
    return table(spark, sf_dir, "conversations").select(
        at(turn).alias("id"),
        F.when(turn == 0, "forum").otherwise("user").alias("source"),
        published.alias("published"),
        published.alias("updated"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(False).alias("tags_enriched"),
        F.lit(False).alias("og_enriched"),
        F.lit(None).cast("string").alias("og_enriched_error"),
        F.lit(0).cast("bigint").alias("like_count"),
        F.lit(0).cast("bigint").alias("dislike_count"),
        ((F.col("conv_id") + turn) % 13 == 0).alias("deleted"),
        F.when(turn == 0, article).otherwise(note).alias("object_json"),
    )


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and threads together: the objects the requests act on."""
    return objects(spark, sf_dir).unionByName(notes(spark, sf_dir))


def comment_key(event: Column, actor: Column) -> Column:
    """Unique part of the id of the comment made by an event's request."""
    return F.sha2(F.concat(F.lit("Create|"), actor, F.lit("|r"), event.cast("string")), 256)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User requests from events, aimed at articles, threads and comments made earlier in the same batch.

    event_id modulo 4 picks the target: 0 an article, 1 and 2 a conversation turn, 3 the comment the event
    seven before the last multiple of seven may have made. A few requests are malformed.
    """
    event = F.col("event_id")
    spread = F.col("user_id") * 1009 + _k() * 31 + event
    conversations, turns = (_size(spark, sf_dir, "conversations", c) for c in ("conv_id", "turn"))
    earlier = event - 1 - event % 7
    actor = F.concat(F.lit("users/"), F.col("user_id").cast("string"))
    turn = F.concat(
        F.lit("conv/"), (spread % conversations).cast("string"), F.lit("/"),
        F.when(event % 4 == 1, _k() % turns).otherwise(0).cast("string"),
    )
    # the earlier event's actor is only known to the earlier event, so the comment id is looked up by join
    made = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup").select(
        event.alias("earlier"),
        F.concat(
            F.lit("https://example.org/ap/objects/comments/"),
            comment_key(event, actor),
        ).alias("made_id"),
    )
    joined = table(spark, sf_dir, "events").withColumn("earlier", earlier).join(made, "earlier", "left")
    target = (
        F.when(event % 4 == 0, _doc(spread % _size(spark, sf_dir, "documents", "doc_id")))
        .when(event % 4 == 3, F.coalesce("made_id", F.lit("comments/none")))
        .otherwise(turn)
    )
    kind = (
        F.when(event % 101 == 0, F.lit(None).cast("string"))
        .when(event % 103 == 0, "Announce")
        .when(F.col("event_type") == "click", "Like")
        .when(F.col("event_type") == "error", "Dislike")
        .when(F.col("event_type") == "signup", "Create")
        .when(F.col("event_type") == "view", "Update")
        .otherwise("Delete")
    )
    comment = F.to_json(
        F.struct(
            F.when(event % 41 == 0, "Article").otherwise("Note").alias("type"),
            F.concat(F.lit("comment "), event.cast("string")).alias("content"),
            F.when(event % 43 != 0, target).alias("inReplyTo"),
        )
    )
    edit = F.to_json(
        F.struct(
            F.when(event % 47 != 0, target).alias("id"),
            F.when(event % 2 == 0, F.concat(F.lit("name "), event.cast("string"))).alias("name"),
            F.when(event % 3 == 0, F.concat(F.lit("text "), event.cast("string"))).alias("content"),
        )
    )
    has_object = F.col("event_type").isin("signup", "view")
    return joined.select(
        F.concat(F.lit("r"), event.cast("string")).alias("request_id"),
        kind.alias("type"),
        actor.alias("actor"),
        F.when(~has_object & (event % 97 != 0), target).alias("object_id"),
        F.when(F.col("event_type") == "signup", comment).when(F.col("event_type") == "view", edit).alias("object_json"),
        F.col("ts").alias("received_at"),
    )


def edits(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Later versions of two thirds of the articles and as many new ones: (doc_id, id, source, ...)."""
    number = F.col("doc_id")
    fresh = number % 3 == 0
    shifted = F.when(fresh, number + 1_000_000_000).otherwise(number)
    return (
        (stream_table if stream else table)(spark, sf_dir, "documents")
        .select(
            _doc(shifted).alias("id"),
            F.concat(F.col("source"), F.lit("-feed")).alias("source"),
            minutes_after_origin(number * 37 % 43200 + 5).alias("published"),
            F.when(number % 31 != 0, minutes_after_origin(number * 37 % 43200 + 500)).alias("updated"),
            F.concat(F.lit('{"name":"edit '), number.cast("string"), F.lit('"}')).alias("object_json"),
        )
    )


def _escaped(text: Column) -> Column:
    """A whole text as it stands in XML or in a quoted attribute."""
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


FEED_ITEMS = 40


def feed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, xml): feed documents of up to FEED_ITEMS articles with neighbouring numbers, in the shapes feeds come in.

    Every 37th article is a feed of its own.
    """
    number = F.col("doc_id")
    published = minutes_after_origin(number * 37 % 43200)
    title = _escaped(F.coalesce("text", F.lit("")))
    item = F.concat(
        F.lit("<item><title>"), title, F.lit(" &amp;amp; more</title>"),
        F.when(number % 13 != 0, F.concat(F.lit("<link> https://news.example/"), number.cast("string"), F.lit("</link>"))).otherwise(""),
        F.lit("<description>&lt;p&gt;"), title, F.lit("&lt;/p&gt;  &lt;b&gt;x&lt;/b&gt;</description>"),
        F.when(number % 11 != 0, F.concat(F.lit("<pubDate>"), F.date_format(published, "E, dd MMM yyyy HH:mm:ss"),
               F.when(number % 2 == 0, F.lit(" +0200")).otherwise(" GMT"), F.lit("</pubDate>"))).otherwise(""),
        F.when(number % 3 == 0, F.concat(F.lit('<media:thumbnail url="https://img.example/t'), number.cast("string"), F.lit('.jpg"/>'))).otherwise(""),
        F.when(number % 3 <= 1, F.concat(F.lit('<enclosure url="https://img.example/a.mp3" type="audio/mpeg"/><enclosure url="https://img.example/e'), number.cast("string"), F.lit('.jpg" type="image/jpeg"/>'))).otherwise(""),
        F.lit("</item>"),
    )
    source = F.when(number % 4 == 0, "hs").when(number % 4 == 1, "is").otherwise(F.col("source"))
    page = F.when(number % 37 == 0, -1 - number).otherwise(F.floor(number / FEED_ITEMS))
    items = dealt_out(table(spark, sf_dir, "documents")).select(source.alias("source"), page.alias("page"), "doc_id", item.alias("item"))
    # at most FEED_ITEMS a group
    documents = items.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>c</title>'),
        F.when(F.col("page") % 2 == 0, F.lit("<image><url>https://img.example/channel.png</url></image>")).otherwise(""),
        F.array_join(F.col("items.item"), ""), F.lit("</channel></rss>"),
    )
    return documents.select("source", xml.alias("xml"))


def cut_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds, those with a sound enclosure cut off in their last item."""
    return feed_xml(spark, sf_dir).withColumn("xml", F.expr("if(xml like '%audio/mpeg%', substring(xml, 1, length(xml) - 40), xml)"))


def og_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): the given pages' bodies do not carry page metadata, so heads are made from documents."""
    number = F.col("doc_id")
    n = number.cast("string")
    title = _escaped(F.coalesce("text", F.lit("")))
    head = F.concat(
        F.lit("<!DOCTYPE html><html><head><!-- <meta property='og:title' content='hidden'> --><title>Page "), n, F.lit(" &amp; more</title>"),
        F.when(number % 4 != 0, F.concat(F.lit('<meta property="og:title" content="First"><META content="'), title, F.lit('" property="OG:Title" />'))).otherwise(""),
        F.when(number % 4 <= 1, F.concat(F.lit("<meta name='Description' content='plain "), n, F.lit("'>"))).otherwise(""),
        F.when(number % 4 >= 1, F.concat(F.lit('<meta property="og:description" content="a &gt; b '), n, F.lit('"/>'))).otherwise(""),
        F.when(number % 2 == 0, F.concat(F.lit('<meta property="og:image" content="https://img.example/og'), n, F.lit('.png"><meta property="og:image" content="">'))).otherwise(""),
        F.when(number % 3 == 0, F.lit('<meta property="og:site_name" content="Site &quot;X&quot;">')).otherwise(""),
        F.when(number % 5 == 1, F.lit('<meta property="article:published_time" content="2024-01-05T10:00:00Z">')).otherwise(""),
        F.when(number % 5 == 2, F.lit('<meta property="article:published_time" content="yesterday">')).otherwise(""),
        F.when(number % 6 == 1, F.lit('<meta property="article:modified_time" content="2024-01-06T10:00:00+02:00">')).otherwise(""),
        F.when(number % 5 == 0, F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/rss/'), n, F.lit('.xml">'))).otherwise(""),
        F.lit("</head><body>"),
        F.when(number % 7 == 0, F.concat(F.lit('<a href="/about">x</a><a class="b" href="/news/'), n, F.lit('/rss">feed</a>'))).otherwise(""),
        F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/doc/"), n)
    return dealt_out(table(spark, sf_dir, "documents")).select(url.alias("url"), head.alias("html"))


def config_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config rows, two per document source: a stored feed address and a fetch marker."""
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("top"))
    common = {"updated_at": F.expr(ORIGIN), "updated_by": F.lit("seed")}
    urls = sources.select(
        F.concat(F.lit("rss."), F.col("source"), F.lit(".rss_url")).alias("key"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/rss")).alias("value"),
    )
    marks = sources.filter("top % 2 = 0").select(
        F.concat(F.lit("rss."), F.col("source"), F.lit(".last_fetched_at")).alias("key"),
        F.lit("2024-01-02T00:00:00Z").alias("value"),
    )
    return urls.unionByName(marks).withColumns(common)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per benchmark item: all its words as typed, with repeats and white space around them.

    Some have no usable tag, some no n, and some an n out of bounds.
    """
    item = F.col("item_id")
    typed = F.transform(words(F.col("text")), lambda w: F.concat(F.lit(" \t"), F.upper(w), F.lit("\n")))
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), item.cast("string")).alias("search_id"),
        F.when(item % 11 == 0, F.array(F.lit(" "), F.lit("\n"))).otherwise(typed).alias("tags"),
        F.when(item % 7 != 0, (item * 17 % 503).cast("int")).alias("n"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lexicon made from the benchmark texts: base form = first five letters, class by length."""
    token = F.explode(F.array_distinct(words(F.col("text")))).alias("token")
    tokens = table(spark, sf_dir, "benchmark").select(token).distinct()
    length = F.length("token")
    return tokens.select(
        "token",
        F.substring("token", 1, 5).alias("baseform"),
        F.when(length % 5 == 0, "sidesana").when(length % 5 == 1, "seikkasana").otherwise("nimisana").alias("class"),
    )


def scraped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of which every second stands under the id its page would get, half of those as scraped rows."""
    number = F.regexp_extract("id", r"\d+", 0).cast("bigint")
    page = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("id"))
    return objects(spark, sf_dir).withColumns(
        {
            "id": F.when(number % 2 == 0, scraped_id(page)).otherwise(F.col("id")),
            "source": F.when(number % 4 == 0, "scraped").otherwise(F.col("source")),
        }
    )


def note_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to upsert over the threads: even turns as new versions, odd turns under new ids."""
    turn = F.col("turn")
    id = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    return table(spark, sf_dir, "conversations").select(
        F.when(turn % 2 == 0, id).otherwise(F.concat(id, F.lit("/new"))).alias("id"),
        minutes_after_origin(F.col("conv_id") % 1000).alias("published"),
        F.to_json(F.struct(F.lit("Note").alias("type"), F.concat(F.lit("edit "), F.col("text")).alias("content"))).alias("object_json"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply to every conversation turn and one to every article."""
    turns = notes(spark, sf_dir).select(F.concat(F.lit("re:"), F.col("id")).alias("request_id"), F.col("id").alias("in_reply_to"))
    articles = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("re:"), _doc(F.col("doc_id") * 2)).alias("request_id"), _doc(F.col("doc_id") * 2).alias("in_reply_to")
    )
    return turns.unionByName(articles)
