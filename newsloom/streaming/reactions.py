"""Current reactions as keyed state: a processor that knows the past of its own actors and objects, and nothing else."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATENESS_MICROS = 7 * 24 * 3600 * 1_000_000
CELLS = 16_384
"""Groups that pairs of actor and object are dealt into by hash. Fixed for the life of a stream's checkpoint."""
FEW = 16
"""Requests of a pair that are kept in its own entry; more of them are rows of their own."""
LIMIT = 64
"""Kept requests of a pair from which on old ones are looked for; later it is twice what was left and as many more."""
READ_ALL = 4
"""Entries of a cell are read in one go where there are at most this many for each pair looked up."""
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = (
    "kind string, request_id string, activity_id string, actor string, object_id string, reaction_type string, at bigint"
)
_PAIR = "actor string, object_id string"
_PAST = (
    "recent array<struct<at: bigint, request_id: string, type: string, activity_id: string>>, "
    "older struct<type: string, activity_id: string, at: bigint, until_at: bigint, until_id: string, limit: bigint>, "
    "many struct<type: string, activity_id: string, at: bigint, last_at: bigint, last_id: string, kept: bigint>"
)
_REQUEST = f"{_PAIR}, at bigint, request_id string"
_ACTION = "type string, activity_id string"
_OUT = Row("kind", "request_id", "activity_id", "actor", "object_id", "reaction_type", "at")


class Reaction(NamedTuple):
    """A current reaction: its type, and the activity and time of the request that set it."""

    type: str | None = None
    activity_id: str | None = None
    at: int | None = None


def after(reaction: Reaction, requests: Iterable[tuple[int, str, str, str]]) -> Reaction:
    """The reaction after requests (at, request_id, type, activity_id) in order; one of the type that is set does nothing."""
    for at, _, kind, activity_id in requests:
        if kind != reaction.type:
            reaction = Reaction(kind, activity_id, at)
    return reaction


class Past:
    """What is known of one pair: what its old requests led to (``start``, the last of them ``until``) and the kept ones.

    Up to FEW kept requests are in ``recent``. Beyond that it is None; they are rows of the ``requests`` map, and ``now`` and
    ``last`` say what they led to and which is the newest.
    """

    def __init__(self, row=None):
        recent, older, many = row if row is not None else ((), None, None)
        older = older or (None, None, None, None, None, LIMIT)
        self.start, self.until, self.limit = Reaction(*older[:3]), tuple(older[3:5]), older[5]
        if recent is None:
            self.recent, self.now, self.last, self.kept = None, Reaction(*many[:3]), tuple(many[3:5]), many[5]
        else:
            self.recent = [tuple(r) for r in recent]
            self.now, self.kept = after(self.start, self.recent), len(self.recent)
            self.last = self.recent[-1][:2] if self.recent else (None, None)

    def row(self) -> tuple:
        older = (*self.start, *self.until, self.limit)
        return (
            self.recent,
            older if self.until[0] is not None or self.limit != LIMIT else None,
            (*self.now, *self.last, self.kept) if self.recent is None else None,
        )


class CurrentReaction(StatefulProcessor):
    """Keeps the reactions of a cell of (actor, object) pairs, each whatever the order and number of deliveries.

    Requests of the last days before a pair's newest are kept by themselves; older ones are only what they led to. A request that
    comes after all others continues from the current reaction; one that comes in between is put in its place and the
    kept ones are gone through again; a request seen before changes nothing. One older than what is kept is given back as
    ``late``. All of it depends on the pair's own requests alone, so no other pair's clock can drop a row.

    Every call to the state is a message to the JVM and back, which costs more than the work on a request. Pairs are dealt
    into cells for that: one call tells whether a cell knows any pair, a new pair is one call, a known one two at most.
    """

    def __init__(self, lateness: int = LATENESS_MICROS):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "pairs bigint")
        self.pairs = handle.getMapState("pairs", _PAIR, _PAST)
        self.requests = handle.getMapState("requests", _REQUEST, _ACTION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[tuple, set] = {}
        for r in rows:
            arrived.setdefault((r["actor"], r["object_id"]), set()).add((r["at"], r["request_id"], r["type"], r["activity_id"]))
        size = self.size.get()
        size = size[0] if size else 0
        known = self._known(arrived, size)
        added = 0
        for pair, requests in arrived.items():
            row = known.get(pair)
            past = Past(row)
            before, fresh = past.now, []
            for late in self._take(pair, past, sorted(requests), fresh):
                yield _OUT("late", late[1], late[3], *pair, late[2], late[0])
            if not fresh:
                continue
            added += row is None
            self.pairs.updateValue(pair, past.row())
            if past.now != before:
                yield _OUT("state", None, past.now.activity_id, *pair, past.now.type, past.now.at)
        if added:
            self.size.update((size + added,))

    def _known(self, pairs: Iterable[tuple], size: int) -> dict[tuple, tuple]:
        """The entries of these pairs; others may be among them."""
        if not size:
            return {}
        if size <= READ_ALL * len(pairs):
            return {tuple(pair): row for pair, row in self.pairs.iterator()}
        return {pair: self.pairs.getValue(pair) for pair in pairs}

    def _take(self, pair: tuple, past: Past, requests: list[tuple], fresh: list[tuple]) -> Iterator[tuple]:
        """Put a pair's requests into its past; those not seen before are added to ``fresh``, late ones returned."""
        seen = None if past.recent is None else {r[:2] for r in past.recent}
        for r in requests:
            place = r[:2]
            if past.until[0] is not None and place <= past.until:
                yield r
            elif seen is None:
                if not self.requests.containsKey((*pair, *place)):
                    self.requests.updateValue((*pair, *place), r[2:])
                    fresh.append(r)
            elif place not in seen:
                seen.add(place)
                fresh.append(r)
        if not fresh:
            return
        first_ever = past.last[0] is None
        displaced = not first_ever and fresh[0][:2] < past.last
        newest = fresh[-1][:2] if first_ever else max(fresh[-1][:2], past.last)
        past.kept += len(fresh)
        if displaced or past.kept > past.limit:
            self._reordered(pair, past, fresh, newest)
        else:
            past.now = after(past.now, fresh)
            if past.recent is not None:
                self._keep(pair, past, past.recent + fresh)
        past.last = newest

    def _reordered(self, pair: tuple, past: Past, fresh: list[tuple], newest: tuple) -> None:
        """Go through all kept requests again; those before the last days become the start."""
        if past.recent is None:
            entries = sorted((*k[2:], *v) for k, v in self.requests.iterator() if tuple(k[:2]) == pair)
        else:
            entries = sorted(past.recent + fresh)
        old = [e for e in entries if e[0] < newest[0] - self.lateness]
        if old:
            past.start, past.until = after(past.start, old), old[-1][:2]
            if past.recent is None:
                for e in old:
                    self.requests.removeKey((*pair, *e[:2]))
        entries = entries[len(old):]
        past.kept, past.limit = len(entries), 2 * len(entries) + LIMIT
        past.now = after(past.start, entries)
        if past.recent is not None:
            self._keep(pair, past, entries)

    def _keep(self, pair: tuple, past: Past, entries: list[tuple]) -> None:
        """Entries of a pair that had few; where they are more now, they become rows of their own."""
        if len(entries) <= FEW:
            past.recent = entries
            return
        past.recent = None
        for e in entries:
            self.requests.updateValue((*pair, *e[:2]), e[2:])

    def close(self) -> None:
        pass


def current_reaction_changes(attempts: DataFrame, lateness: int = LATENESS_MICROS) -> DataFrame:
    """Changed reactions (kind ``state``) and requests that came too late (kind ``late``) of a stream of valid requests.

    ``attempts`` has request_id, activity_id, type, actor, target_id, received_at. Rows without an actor, target or type of
    reaction are not requests to react and have no place here.
    """
    keyed = attempts.filter(F.col("type").isin("Like", "Dislike")).select(
        "actor", F.col("target_id").alias("object_id"), "request_id", "activity_id", "type",
        F.unix_micros(F.col("received_at").cast("timestamp")).alias("at"),
    ).filter("actor is not null and object_id is not null and request_id is not null and at is not null")
    cell = F.pmod(F.xxhash64("actor", "object_id"), F.lit(CELLS)).cast("int")
    changed = keyed.withColumn("cell", cell).groupBy("cell").transformWithState(
        statefulProcessor=CurrentReaction(lateness), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
    return changed.withColumn("published", F.timestamp_micros("at")).drop("at")
