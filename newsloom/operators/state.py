"""Job state in the config table, and resumable fetch windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators.merge import S, latest_per_key, merge
from newsloom.sources.pages import feed_page


def config_put(config: DataFrame, rows: DataFrame, now: Column, by: str) -> DataFrame:
    """Set values (key, value); keys are added or updated, never removed."""
    source = latest_per_key(rows.select("key", "value"), "key", [F.desc("value")]).withColumn("now", now)
    return merge(
        config,
        source,
        {"value": S("value"), "updated_at": S("now"), "updated_by": F.lit(by)},
        on="key",
        insert={"key": F.col("key"), "value": F.col("value"), "updated_at": F.col("now"), "updated_by": F.lit(by)},
    )


def config_get(config: DataFrame, keys: DataFrame, default: Column | None = None) -> DataFrame:
    """Value for every key in ``keys`` (column key), or the default."""
    found = keys.join(config.select("key", "value"), "key", "left")
    return found.withColumn("value", F.coalesce("value", F.lit(None).cast("string") if default is None else default))


def feed_url_key(name: Column) -> Column:
    """Config key of a feed's discovered address. Fixed value: one feed has a key of its own."""
    return F.when(name == "valtioneuvosto", "valtioneuvosto.rss_url").otherwise(
        F.concat(F.lit("rss."), name, F.lit(".rss_url"))
    )


def last_fetched_key(source: Column) -> Column:
    return F.concat(F.lit("rss."), source, F.lit(".last_fetched_at"))


def resolved_feeds(feeds: DataFrame, config: DataFrame, discovered: DataFrame) -> DataFrame:
    """(name, feed_url): fixed address, or for autodiscovered feeds the stored one, else the one just found on
    the feed's page (page_url, feed_url; see feed_page). :func:`unresolved_feeds` has those without any address."""
    return _addresses(feeds, config, discovered).filter(F.col("feed_url").isNotNull())


def unresolved_feeds(feeds: DataFrame, config: DataFrame, discovered: DataFrame) -> DataFrame:
    """(name): feeds for which there is no address."""
    return _addresses(feeds, config, discovered).filter(F.col("feed_url").isNull()).select("name")


def _addresses(feeds: DataFrame, config: DataFrame, discovered: DataFrame) -> DataFrame:
    stored = config.select(F.col("key").alias("config_key"), F.col("value").alias("stored_url"))
    found = latest_per_key(discovered, "page_url", [F.col("feed_url")])
    return (
        feeds.withColumn("config_key", feed_url_key(F.col("name")))
        .join(stored, "config_key", "left")
        .withColumn("page_url", feed_page(F.col("url")))
        .join(found.select("page_url", F.col("feed_url").alias("found_url")), "page_url", "left")
        .select(
            "name",
            F.when(F.col("autodiscover"), F.coalesce("stored_url", "found_url")).otherwise(F.col("url")).alias("feed_url"),
        )
    )


def discovered_config(feeds: DataFrame, config: DataFrame, discovered: DataFrame) -> DataFrame:
    """(key, value) rows for config_put: addresses found for autodiscovered feeds that had none stored."""
    fresh = feeds.filter("autodiscover").select(feed_page(F.col("url")).alias("page_url"), feed_url_key(F.col("name")).alias("key"))
    found = latest_per_key(discovered, "page_url", [F.col("feed_url")]).filter(F.col("feed_url").isNotNull())
    return (
        fresh.join(config.select("key"), "key", "left_anti")
        .join(found.select("page_url", F.col("feed_url").alias("value")), "page_url")
        .select("key", "value")
    )


def new_since(
    df: DataFrame, config: DataFrame, now: Column, time: str = "published", source: str = "source",
    fallback: str = "24 hours",
) -> DataFrame:
    """Rows newer than their source's last successful fetch; a source without one goes back by ``fallback``.

    The markers (one row per source) are joined, so sources of any number can be read in one scan.
    """
    kind = df.schema[time].dataType
    markers = config.select(F.col("key").alias("_key"), F.try_to_timestamp("value").alias("_since"))
    keyed = df.withColumn("_key", last_fetched_key(F.col(source))).join(markers, "_key", "left")
    since = F.coalesce(F.col("_since"), now.cast("timestamp") - F.expr(f"interval {fallback}")).cast(kind)
    return keyed.filter(F.col(time) > since).drop("_key", "_since")


def advanced_markers(config: DataFrame, fetched: DataFrame, run_time: Column, now: Column, by: str) -> DataFrame:
    """Config after a successful run over the sources in ``fetched`` (call it only when the write succeeded)."""
    rows = fetched.select("source").distinct().select(
        last_fetched_key(F.col("source")).alias("key"), run_time.alias("value")
    )
    return config_put(config, rows, now, by)
