"""Feed documents to items and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.documents import article_document
from newsloom.functions.rows import pinned
from newsloom.functions.text import bare_text, capitalised, strip, unescape
from newsloom.functions.times import parse_any, parse_rfc2822, rfc3339
from newsloom.functions.urls import BASE, article_id
from newsloom.schemas import PUBLISHERS

# every element may be repeated, and the first counts; thumbnails may stand inside media:content or media:group
_THUMBNAILS = "array<struct<_url:string>>"
_CONTENT = f"array<struct<`media:thumbnail`:{_THUMBNAILS}>>"
_ITEM = (
    "struct<title:array<string>,link:array<string>,description:array<string>,pubDate:array<string>,`atom:updated`:array<string>,"
    f"`media:thumbnail`:{_THUMBNAILS},thumbnail:{_THUMBNAILS},`media:content`:{_CONTENT},"
    f"`media:group`:array<struct<`media:thumbnail`:{_THUMBNAILS},`media:content`:{_CONTENT}>>,"
    "enclosure:array<struct<_url:string,_type:string>>>"
)
# an ampersand that begins none of the references XML itself knows
_STRAY = "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"
# where an item begins
_ITEM_START = r"(?=<item[\s>])"
_IMAGE = "image struct<url:string>"
# items stand inside the channel (RSS 2.0) or next to it (RSS 1.0)
FEED_SCHEMA = f"channel struct<{_IMAGE.replace(' ', ':', 1)},item:array<{_ITEM}>>, {_IMAGE}, item array<{_ITEM}>"

# Publisher of each known source code.
KNOWN_PUBLISHERS = [
    ("hs", "Helsingin Sanomat", "https://www.hs.fi"),
    ("iltalehti", "Iltalehti", "https://www.iltalehti.fi"),
    ("is", "Ilta-Sanomat", "https://www.is.fi"),
    ("kauppalehti", "Kauppalehti", "https://www.kauppalehti.fi"),
    ("mtv", "MTV Uutiset", "https://www.mtvuutiset.fi"),
    ("valtioneuvosto", "Valtioneuvosto", "https://valtioneuvosto.fi"),
]


def load_feeds(feed_lists: DataFrame, column: str = "feeds") -> DataFrame:
    """(name, url, autodiscover) from JSON lists; entries without a name or an address are skipped."""
    parsed = F.from_json(column, "array<struct<name:string,url:string,autodiscover:boolean>>")
    return (
        feed_lists.select(F.explode(parsed).alias("feed"))
        .select("feed.name", "feed.url", F.coalesce("feed.autodiscover", F.lit(False)).alias("autodiscover"))
        .filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    )


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): one row per saved feed file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")
    )


def _image_enclosure(item: Column) -> Column:
    images = F.filter(
        item["enclosure"],
        lambda part: part["_type"].startswith("image/") & part["_url"].isNotNull() & (part["_url"] != ""),
    )
    return F.try_element_at(images, F.lit(1))["_url"]


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _thumbnails(item: Column) -> list[Column]:
    group = item["media:group"]
    return [
        item["media:thumbnail"]["_url"], F.flatten(item["media:content"]["media:thumbnail"])["_url"],
        F.flatten(group["media:thumbnail"])["_url"], F.flatten(F.flatten(group["media:content"])["media:thumbnail"])["_url"],
        item["thumbnail"]["_url"],
    ]


def image_url(item: Column, channel_image: Column) -> Column:
    """First thumbnail of the item, else its first image enclosure, else the channel's image."""
    return F.coalesce(
        *[_first(F.filter(urls, lambda url: url.isNotNull() & (url != ""))) for urls in _thumbnails(item)],
        _image_enclosure(item),
        strip(channel_image),
    )


def _parsed(xml: Column) -> Column:
    """A feed document, NULL when it cannot be read."""
    feed = F.from_xml(xml, FEED_SCHEMA)
    return F.when(feed["channel"].isNotNull() | feed["item"].isNotNull(), feed)


def _fragments(xml: Column) -> Column:
    """What begins with an item's start tag and ends before the next one's, of a damaged document."""
    return F.filter(F.split(xml, _ITEM_START), lambda piece: piece.rlike("^" + _ITEM_START))


def _as_feed(fragment: Column) -> Column:
    """A feed of the fragment's item alone, NULL where the item has no end."""
    item = F.nullif(F.regexp_extract(fragment, r"(?s)^.*?</item\s*>", 0), F.lit(""))
    return F.concat(F.lit("<rss><channel>"), F.regexp_replace(item, _STRAY, "&amp;"), F.lit("</channel></rss>"))


def _read(feeds: DataFrame, xml: str) -> DataFrame:
    """Feeds with ``feed``, the parsed document, and for documents that cannot be read as a whole ``pieces``.

    A document that is not well-formed is read again with its stray ampersands and unknown entities escaped. Where that does
    not help, it is cut at its items, and each is read by itself: a piece has its ``fragment`` and its ``feed``, which is NULL
    where the item itself is damaged. The channel's image is then looked for before the first item.
    """
    once = pinned(feeds.withColumn("feed", _parsed(F.col(xml))), "feed")
    again = _parsed(F.when(F.col("feed").isNull(), F.regexp_replace(xml, _STRAY, "&amp;")))
    read = pinned(once.withColumn("feed", F.coalesce("feed", again)), "feed")
    damaged = F.when(F.col("feed").isNull(), F.col(xml))
    pieces = F.transform(_fragments(damaged), lambda f: F.struct(f.alias("fragment"), _parsed(_as_feed(f)).alias("feed")))
    head = F.element_at(F.split(damaged, _ITEM_START, 2), 1)
    image = F.regexp_extract(head, r"(?s)<image\s*>.*?<url\s*>(.*?)</url", 1)
    return pinned(read.withColumns({"pieces": pieces, "head_image": F.nullif(image, F.lit(""))}), "pieces")


def _readable(pieces: str = "pieces") -> Column:
    return F.exists(pieces, lambda piece: piece["feed"].isNotNull())


def rejected_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Feeds of which nothing can be read, not one item, with the reason."""
    blank = F.coalesce(strip(F.col(xml)), F.lit("")) == ""
    nothing = F.col("feed").isNull() & ~F.coalesce(_readable(), F.lit(False))
    return _read(feeds, xml).filter(nothing).withColumn(
        "reason", F.when(blank, "empty document").otherwise("not readable as a feed")).drop("feed", "pieces", "head_image")


def damaged_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """What is left of damaged documents when the items that can be read are taken out: a row per ``fragment``, with the reason.

    Documents of which nothing can be read are in :func:`rejected_feeds` as a whole instead.
    """
    carried = [name for name in feeds.columns if name != xml]
    lost = _read(feeds, xml).filter(F.col("feed").isNull() & _readable()).select(*carried, F.explode("pieces").alias("piece"))
    return lost.filter("piece.feed is null").select(*carried, "piece.fragment", F.lit("not readable as an item").alias("reason"))


def raw_items(feeds: DataFrame, xml: str = "xml", atom_dates: bool = False) -> DataFrame:
    """Every item of every feed document, dated or not, with title and summary as they stand; other input columns are carried along.

    Cleaning the texts (:func:`cleaned_items`) is most of the work, so it comes after whatever chooses items. Of a damaged document these are the items that can be read by themselves. ``atom_dates`` also accepts an item's
    atom:updated: as the publication date when there is none, and as the update time.
    """
    carried = [name for name in feeds.columns if name != xml]
    parsed = _read(feeds, xml).select(*carried, "feed", "pieces", "head_image")
    none = F.array().cast(f"array<{_ITEM}>")
    items = F.concat(
        F.coalesce("feed.channel.item", none),
        F.coalesce("feed.item", none),
        F.coalesce(F.flatten(F.transform("pieces", lambda piece: F.coalesce(piece["feed"]["channel"]["item"], none))), none),
    )
    channel_image = F.coalesce("feed.channel.image.url", "feed.image.url", "head_image")
    # explode_outer: explode would put a filter on the array below and parse every document once more for it
    rows = parsed.select(*carried, channel_image.alias("channel_image"), F.explode_outer(items).alias("item")).filter(
        "item is not null"
    )
    item = F.col("item")
    date = strip(_first(item["pubDate"]))
    published = parse_rfc2822(date)
    updated = published
    if atom_dates:
        atom = parse_any(strip(_first(item["atom:updated"])))
        published = F.coalesce(published, parse_any(date), atom)
        updated = F.coalesce(atom, published)
    fields = rows.select(
        *carried,
        _first(item["title"]).alias("title"),
        F.coalesce(strip(_first(item["link"])), F.lit("")).alias("link"),
        _first(item["description"]).alias("summary"),
        published.alias("published"),
        updated.alias("updated"),
        image_url(item, F.col("channel_image")).alias("image_url"),
    )
    return pinned(fields, "published", "link")


def cleaned_items(items: DataFrame) -> DataFrame:
    """Items with clean titles and summaries."""
    bare = items.withColumns({name: bare_text(F.col(name)) for name in ["title", "summary"]})
    return bare.withColumns({name: strip(unescape(F.col(name))) for name in ["title", "summary"]})


def feed_items(feeds: DataFrame, xml: str = "xml", atom_dates: bool = False) -> DataFrame:
    """:func:`raw_items` with clean texts."""
    return cleaned_items(raw_items(feeds, xml, atom_dates))


def dated_items(feeds: DataFrame, xml: str = "xml", atom_dates: bool = False) -> DataFrame:
    """Raw items with a date and a link. (Items without a link would all share one id.)"""
    return raw_items(feeds, xml, atom_dates).filter(F.col("published").isNotNull() & (F.col("link") != ""))


def parse_feeds(feeds: DataFrame, xml: str = "xml", atom_dates: bool = False) -> DataFrame:
    """:func:`dated_items` with clean texts."""
    return cleaned_items(dated_items(feeds, xml, atom_dates))


def undated_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Items with a link but no readable date: they wait until another source dates them."""
    return feed_items(feeds, xml).filter(F.col("published").isNull() & (F.col("link") != ""))


def rejected_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Items that parse_feeds leaves out, with the reason."""
    items = feed_items(feeds, xml)
    reason = F.when(F.col("link") == "", "no link").when(F.col("published").isNull(), "no readable date")
    return items.withColumn("reason", reason).filter("reason is not null")


def publishers(spark: SparkSession) -> DataFrame:
    """The fixed publisher dimension (six rows)."""
    return spark.createDataFrame(KNOWN_PUBLISHERS, PUBLISHERS)


def with_publisher(articles: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Add publisher_name and publisher_url; an unknown source is its own name, capitalised, without an address."""
    known = F.broadcast(publishers(articles.sparkSession)) if dimension is None else dimension
    joined = articles.join(
        known.select("source", F.col("name").alias("publisher_name"), F.col("url").alias("publisher_url")),
        "source",
        "left",
    )
    return joined.withColumns(
        {
            "publisher_name": F.coalesce("publisher_name", capitalised(F.col("source"))),
            "publisher_url": F.coalesce("publisher_url", F.lit("")),
        }
    )


def feed_articles(items: DataFrame, base: str = BASE) -> DataFrame:
    """Items (with their feed's ``source``) as rows for upsert_articles."""
    rows = with_publisher(items).withColumn("id", article_id(F.col("source"), F.col("link"), base))
    document = article_document(
        id=F.col("id"),
        url=F.col("link"),
        name=F.col("title"),
        summary=F.col("summary"),
        published=rfc3339(F.col("published")),
        updated=rfc3339(F.col("updated")),
        author=F.col("publisher_name"),
        author_url=F.col("publisher_url"),
        image_url=F.col("image_url"),
    )
    return rows.select("id", "source", "published", "updated", document.alias("object_json"))
