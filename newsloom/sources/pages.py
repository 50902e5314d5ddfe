"""Metadata and feed links from saved web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.rows import pinned
from newsloom.functions.text import bind, unescape
from newsloom.functions.urls import absolute_url, site

# begins with a character, so that what cannot match is passed quickly
_INVISIBLE = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"
_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"

# Which property fills which column.
PROPERTIES = {
    "title": "og:title",
    "description": "og:description",
    "image": "og:image",
    "url": "og:url",
    "site_name": "og:site_name",
    "published_time": "article:published_time",
    "modified_time": "article:modified_time",
}


def _tags(html: Column, name: str) -> Column:
    """Opening tags of one element; quoted values may contain '>', and a quote anywhere else is a character."""
    return F.regexp_extract_all(html, F.lit(rf"""(?is)<{name}\b(?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+>"""), F.lit(0))


def _attributes(tag: Column) -> Column:
    """Attributes of a tag in order, names in lower case, values without quotes."""
    space = F.lit(" \t\n\x0b\f\r")

    def unquoted(value: Column) -> Column:
        quoted = F.substring(value, 1, 1).isin("'", '"')
        return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(F.regexp_replace(value, r"[\"']$", ""))

    def read(part: Column) -> Column:
        # a name has no equals sign, so the first one ends it
        name = F.lower(F.rtrim(F.substring_index(part, "=", 1), space))
        value = bind(F.ltrim(F.substring(part, F.instr(part, "=") + 1, F.length(part)), space), unquoted)
        return F.struct(name.alias("name"), value.alias("value"))

    return F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), read)


def _attribute(attributes: Column, name: str) -> Column:
    return F.try_element_at(F.filter(attributes, lambda part: part["name"] == name), F.lit(1))["value"]


def _tag_rows(html: Column, name: str, wanted: list[str]) -> Column:
    """Array of structs with the wanted attributes of every tag."""
    return F.transform(
        F.transform(_tags(html, name), _attributes),
        lambda parts: F.struct(*[_attribute(parts, attribute).alias(attribute) for attribute in wanted]),
    )


def _visible(html: Column) -> Column:
    return F.regexp_replace(html, _INVISIBLE, " ")


def extract_page_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``page_url`` plus title, description, image, url, site_name, published_time and modified_time.

    Of several tags for one property the last with content wins; a plain description counts only when no
    description precedes it; the title element is used when no title is given.
    """
    carried = [name for name in pages.columns if name not in (html, url)]
    read = pages.select(*carried, F.col(url).alias("page_url"), _visible(F.col(html)).alias("visible"))
    metas = F.filter(
        _tag_rows(F.col("visible"), "meta", ["property", "name", "content"]),
        lambda tag: F.coalesce(tag["content"], F.lit("")) != "",
    )
    tagged = read.select(*carried, "page_url", metas.alias("metas"), F.regexp_extract("visible", _TITLE, 1).alias("title_tag"))

    def last(name: str) -> Column:
        found = F.filter("metas", lambda tag: F.lower(tag["property"]) == PROPERTIES[name])
        return F.try_element_at(found, F.lit(-1))["content"]

    # a property overrides at any place, a plain description only fills an empty field
    plain = F.filter(
        "metas",
        lambda tag: (F.lower(tag["name"]) == "description")
        & ~F.coalesce(F.lower(tag["property"]), F.lit("")).isin(*PROPERTIES.values()),
    )
    columns = {name: last(name) for name in PROPERTIES}
    columns["title"] = F.coalesce(columns["title"], F.col("title_tag"))
    columns["description"] = F.coalesce(columns["description"], F.try_element_at(plain, F.lit(1))["content"])
    raw = tagged.select(*carried, "page_url", *[column.alias(name) for name, column in columns.items()])
    decoded = raw.withColumns({name: unescape(F.col(name)) for name in columns})
    return pinned(decoded.withColumn("url", F.coalesce("url", "page_url")), *columns)


def feed_page(url: Column) -> Column:
    """The page to search for feed links. Fixed value: one publisher lists its feeds on a page of their own."""
    special = F.contains(url, F.lit("valtioneuvosto.fi")) & ~url.endswith("/rss-syotteet")
    return F.when(special, F.concat(site(url), F.lit("/rss-syotteet"))).otherwise(url)


def discover_feed_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``page_url`` and ``feed_url``: the page's declared feed, else its first link with /rss in it, else NULL."""
    carried = [name for name in pages.columns if name not in (html, url)]
    read = pages.select(*carried, F.col(url).alias("page_url"), _visible(F.col(html)).alias("visible"))
    links = _tag_rows(F.col("visible"), "link", ["rel", "type", "href"])
    anchors = _tag_rows(F.col("visible"), "a", ["href"])
    declared = F.filter(
        links,
        lambda tag: F.array_contains(F.split(tag["rel"], r"\s+"), "alternate") & (tag["type"] == "application/rss+xml"),
    )
    mentioned = F.filter(anchors, lambda tag: F.contains(tag["href"], F.lit("/rss")))
    href = F.coalesce(
        F.nullif(F.try_element_at(declared, F.lit(1))["href"], F.lit("")),
        F.try_element_at(mentioned, F.lit(1))["href"],
    )
    found = read.select(*carried, "page_url", href.alias("href"))
    decoded = found.withColumn("href", unescape(F.col("href")))
    return decoded.select(*carried, "page_url", absolute_url(F.col("href"), F.col("page_url")).alias("feed_url"))
