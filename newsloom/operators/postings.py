"""Many tag searches over postings in blocks, of which those that cannot change a result are never opened.

Live objects are numbered from the best to the worst by everything but relevance, which alone depends on the search. A posting
has, for a tag and a block of neighbouring numbers, the numbers that carry the tag, and as bounds the most often one
of them does and the best number. For a search the bounds of its tags add up to the most relevance a block can give. Blocks
are opened from the best bound on, a few at first and then ever more; a search is through as soon as no
block left could beat its n-th result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.operators.objects import live
from newsloom.operators.ordered import numbered
from newsloom.operators.search import MAX_N, normalised_searches
from newsloom.session import stage

BLOCK = 256
"""Objects of a block."""
OPENED = 2
"""Blocks a search opens in its first round; four times as many in each one after it."""
_SHOWN = ["id", "published", "updated", "like_count"]


def standing() -> list[Column]:
    """Order of objects by all but relevance, as search.ranking has it."""
    return [F.desc("like_count"), F.desc("updated"), F.desc_nulls_last("published"), F.asc("id")]


@dataclass
class Postings:
    """``objects``: the shown columns by ``number``. ``blocks``: (tag, block, most, first, members)."""

    objects: DataFrame
    blocks: DataFrame


def build_postings(objects: DataFrame, block: int = BLOCK) -> Postings:
    """Postings of the live objects, written out. A frequent tag has many blocks, and no block more than ``block`` members."""
    ranked = stage(numbered(live(objects).select(*_SHOWN, "tags"), standing(), "number"), "ranked")
    carried = ranked.select("number", F.explode("tags").alias("tag")).filter("tag is not null")
    times = carried.groupBy("tag", "number").agg(F.count("*").alias("times"))
    blocks = times.groupBy("tag", F.floor(F.col("number") / block).alias("block")).agg(
        F.max("times").alias("most"), F.min("number").alias("first"), F.collect_list(F.struct("number", "times")).alias("members"))
    return Postings(ranked.drop("tags"), stage(blocks, "postings"))


def search_postings(postings: Postings, searches: DataFrame, opened: int = OPENED, trace: list[int] | None = None) -> DataFrame:
    """The rows of search.outbox_many for a table of searches (search_id, tags array, optional n).

    ``trace`` gets the number of (search, object) pairs each round forms.
    """
    usable = normalised_searches(searches)
    wanted = stage(usable.select("search_id", F.explode("search").alias("tag")), "wanted")
    sizes = stage(usable.select("search_id", "n"), "sizes")
    bounds = wanted.join(postings.blocks.select("tag", "block", "most", "first"), "tag").groupBy("search_id", "block").agg(
        F.sum("most").alias("bound"), F.min("first").alias("first"))
    left = stage(bounds, "bounds")
    best: DataFrame | None = None
    while left.limit(1).count():
        turn = F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("bound"), "first"))
        now = stage(left.withColumn("turn", turn).filter(F.col("turn") <= opened).select("search_id", "block"), "opened")
        members = wanted.join(now, "search_id").join(postings.blocks.select("tag", "block", "members"), ["tag", "block"])
        pairs = members.select("search_id", F.inline("members")).groupBy("search_id", "number").agg(F.sum("times").alias("relevance"))
        if trace is not None:
            pairs = stage(pairs, "pairs")
            trace.append(pairs.count())
        best = stage(_first(pairs if best is None else best.select(*pairs.columns).unionByName(pairs), sizes), "best")
        last = best.filter("place = n").select("search_id", F.col("relevance").alias("low"), F.col("number").alias("last"))
        can_beat = F.col("low").isNull() | (F.col("bound") > F.col("low")) | ((F.col("bound") == F.col("low")) & (F.col("first") < F.col("last")))
        rest = left.join(now, ["search_id", "block"], "left_anti").join(last, "search_id", "left").filter(can_beat)
        left = stage(rest.select("search_id", "block", "bound", "first"), "bounds")
        opened *= 4
    if best is None:
        best = _first(wanted.select("search_id", F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("relevance")).limit(0), sizes)
    return best.join(postings.objects, "number").select("search_id", *_SHOWN, "relevance", "place")


def _first(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The best n of each search with their place; a task passes on no more than the largest n of each."""
    place = F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("relevance"), "number")).cast("long")
    columns: Sequence[str] = ["search_id", "number", "relevance"]
    return pairs.select(*columns).withColumn("place", place).filter(F.col("place") <= MAX_N).join(sizes, "search_id").filter("place <= n")
