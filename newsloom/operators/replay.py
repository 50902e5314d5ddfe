"""Requests that were answered before: an index of answers, so a batch that is delivered again changes nothing.

Answers lie in folders by hash of the request id. A Bloom filter stands before them: fixed blocks of 32,768 bits, of which an id
has one block and a few bits, made and merged by Spark's bitmap aggregates. Most ids of a new batch are new, and the filter
says so from a few bits each; only folders of ids that may be known are opened. The filter never denies a known id.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.urls import BASE
from newsloom.operators.activities import Outcome, Stage, applied, decide
from newsloom.session import packed
from newsloom.sources.buckets import BucketTable

ANSWERS = "request_id string, status int, reason string, activity_id string, result_id string"
FILTER = "block int, bits binary"
BLOCK_BITS = 32_768
"""Bits of Spark's bitmaps."""
HASHES = 4


def _positions(request_id: Column) -> Column:
    """The bits of an id in its block."""
    return F.array(*[F.pmod(F.xxhash64(request_id, F.lit(seed)), F.lit(BLOCK_BITS)) for seed in range(1, HASHES + 1)])


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


@dataclass
class RequestIndex:
    """Answers by request id, and the filter. ``blocks`` sets the filter's size: about ten bits an id keep one in a hundred
    new ids from being told apart, more ids make more folders be opened in vain, never a wrong answer."""

    answers: BucketTable
    bloom: BucketTable
    blocks: int = 1024

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 64, blocks: int = 1024) -> RequestIndex:
        return cls(BucketTable(spark, f"{path}/answers", "request_id", ANSWERS, buckets), BucketTable(spark, f"{path}/filter-{blocks}", "block", FILTER, 16), blocks)

    def _block(self, request_id: Column) -> Column:
        return F.pmod(F.xxhash64(request_id), F.lit(self.blocks)).cast("int")

    def maybe_known(self, ids: DataFrame) -> DataFrame:
        """The ids (request_id) that the filter does not rule out."""
        asked = ids.select("request_id", self._block(F.col("request_id")).alias("block"), _positions(F.col("request_id")).alias("positions"))
        blocks = self.bloom.read(self.bloom.touched(asked.select("block")))
        hit = F.forall("positions", lambda p: _is_set(F.col("bits"), p))
        return asked.join(blocks, "block").filter(hit).select("request_id")

    def answered(self, ids: DataFrame) -> DataFrame:
        """The stored answers to ids (request_id, distinct)."""
        maybe = packed(self.maybe_known(ids), "maybe-known")
        return self.answers.read(self.answers.touched(maybe)).join(maybe, "request_id", "left_semi")

    def add(self, decided: DataFrame) -> None:
        """Keep the answers of a batch; ids that are known keep the answer they have.

        The filter is written first: an id in the filter without an answer is only looked up in vain, so a run that stops
        in between is repeated.
        """
        new = packed(decided.select(*self.answers.schema.names), "answers")
        bits = new.select(self._block(F.col("request_id")).alias("block"), F.explode(_positions(F.col("request_id"))).alias("position"))
        fresh = bits.groupBy("block").agg(F.bitmap_construct_agg("position").alias("bits"))
        blocks = self.bloom.touched(new.select(self._block(F.col("request_id"))))
        both = self.bloom.read(blocks).unionByName(fresh)
        self.bloom.replace(both.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")), blocks)
        mine = self.answers.touched(new.select("request_id"))
        known = self.answers.read(mine)
        self.answers.replace(known.unionByName(new.join(known.select("request_id"), "request_id", "left_anti")), mine)


class Decisions(NamedTuple):
    """Decisions on requests that are new, and the answers to those that were answered before."""

    decided: DataFrame
    replayed: DataFrame


def decide_once(
    requests: DataFrame, objects: DataFrame, likes: DataFrame, index: RequestIndex, base: str = BASE, keep: Stage = packed
) -> Decisions:
    """Decide the requests the index does not know; the others have no decision, so nothing is made of them again.

    Call ``index.add`` with ``decided`` when what follows from it is written.
    """
    batch = keep(requests)
    replayed = keep(index.answered(batch.select("request_id").distinct()))
    fresh = batch.join(replayed.select("request_id"), "request_id", "left_anti")
    return Decisions(keep(decide(fresh, objects, likes, base, keep)), replayed)


def apply_once(
    requests: DataFrame, objects: DataFrame, likes: DataFrame, index: RequestIndex, base: str = BASE, keep: Stage = packed
) -> tuple[Outcome, DataFrame]:
    """apply_activities for the requests the index does not know, and the answers to the others."""
    decided, replayed = decide_once(requests, objects, likes, index, base, keep)
    return applied(decided, objects, likes), replayed
