"""Addresses and content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASE = "https://example.org/ap"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _ORIGIN, 1))


def authority(url: Column) -> Column:
    """Host with port, as written."""
    return F.regexp_extract(url, _ORIGIN, 2)


def site(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def is_http_url(url: Column) -> Column:
    """True for http(s) addresses that name a host."""
    return F.coalesce(scheme(url).isin("http", "https") & (authority(url) != ""), F.lit(False))


def absolute_url(href: Column, page_url: Column) -> Column:
    """Join root-relative links to the page they stand on; other links stay as they are."""
    return (
        F.when(href.startswith("//"), F.concat(scheme(page_url), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site(page_url), href))
        .otherwise(href)
    )


def article_id(source: Column, url: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(f"{base}/objects/articles/"), source, F.lit("/"), F.sha2(url, 256))


def scraped_id(url: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(f"{base}/objects/scraped/"), F.sha2(url, 256))


def request_key(kind: Column, actor: Column, request_id: Column) -> Column:
    """Unique part of the ids a request creates; a replayed request gets the same ids."""
    return F.sha2(F.concat_ws("|", kind, actor, request_id), 256)


def comment_id(kind: Column, actor: Column, request_id: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(f"{base}/objects/comments/"), request_key(kind, actor, request_id))


def activity_id(kind: Column, actor: Column, request_id: Column, base: str = BASE) -> Column:
    return F.concat(
        F.lit(f"{base}/activities/"), F.lower(kind), F.lit("s/"), request_key(kind, actor, request_id)
    )
