"""Keyed merge and latest-row selection, the base of every table update."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def S(name: str) -> Column:
    """A source column inside the ``update`` and ``when`` expressions of :func:`merge`."""
    return F.col(f"S.{name}")


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``.

    Spark limits each map task to one row per key before the shuffle (WindowGroupLimit), so a key with a
    large share of the rows costs no more than one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def merge(
    target: DataFrame,
    source: DataFrame,
    update: Mapping[str, Column],
    *,
    on: str = "id",
    when: Column | None = None,
    insert: Mapping[str, Column] | None = None,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Target after a merge with a source.

    Of several source rows with one key the first by ``order`` counts; without ``order`` the caller vouches that
    there is at most one.

    Matched rows take the ``update`` columns when ``when`` is true (NULL means no); other target rows stay
    as they are. With ``insert``, source rows without a match are added; columns not listed become NULL.
    Target columns go by their names, source columns by ``S(name)``; ``insert`` expressions see the source.

    A left join plus an anti join is used instead of one full outer join: a small source is then
    broadcast (Spark checks its size) and the large target is never shuffled.
    """
    if order is not None:
        source = latest_per_key(source, on, order)
    types = {field.name: field.dataType for field in target.schema}
    packed = source.select(F.col(on), F.struct(*source.columns).alias("S"))
    joined = target.join(packed, on, "left")
    hit = S(on).isNotNull() if when is None else S(on).isNotNull() & F.coalesce(when, F.lit(False))
    merged = joined.select(
        *[
            F.when(hit, update[name].cast(types[name])).otherwise(F.col(name)).alias(name) if name in update
            else F.col(name)
            for name in target.columns
        ]
    )
    if insert is None:
        return merged
    known = target.select(on).join(source.select(on), on, "left_semi")
    fresh = source.join(known, on, "left_anti")
    return merged.unionByName(
        fresh.select(*[insert.get(name, F.lit(None)).cast(types[name]).alias(name) for name in target.columns])
    )
