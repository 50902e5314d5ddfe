"""Order-dependent logic that never puts a whole large group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.session import stage

SLOT = 1 << 16
"""Rows of the largest group that a plain window may get, and of the slots that larger ones are scanned in."""


def hottest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; counted before the shuffle."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def with_previous(
    df: DataFrame, keys: Sequence[str], time: str, tie: str, value: str, name: str, most: int | None = None, slot: int = SLOT
) -> DataFrame:
    """Add ``name``: ``value`` of the preceding row of the same key by (``time``, ``tie``), NULL for the first.

    ``most`` is a bound on the rows of a key, counted here where the caller has none. A plain ``lag`` sends all rows of
    a key to one task, so beyond ``slot`` rows a key the table is scanned in segments instead; see :func:`segmented_previous`.
    """
    if (hottest(df, keys) if most is None else most) > slot:
        return segmented_previous(df, keys, [time, tie], value, name, slot)
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(time, tie)))


def slotted(df: DataFrame, order: Sequence[str], slot: int = SLOT) -> DataFrame:
    """Rows sorted over the whole table, in files by range, with ``_file``, their ``_row`` in it and its ``_slot`` of ``slot`` rows.

    Ranges are drawn from the whole ``order``, so rows that agree in the first columns are cut apart by the others.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), "ranges")
    return ranged.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
        F.floor(F.col("_metadata.row_index") / slot).alias("_slot"))


def segmented_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, slot: int = SLOT) -> DataFrame:
    """:func:`with_previous` for keys of any size: a scan over slots that hold so many rows whatever their keys.

    Inside a slot the row before is at hand. The first row of a slot takes the last one of the slot before, from a
    summary of a row per slot; the first slot of a file takes the last one of the file before, from a row per file.
    """
    whole = [*keys, *order]
    rows = slotted(df, whole, slot)
    inside = Window.partitionBy("_file", "_slot").orderBy("_row")
    last = F.max_by(F.struct(*keys, F.col(value).alias("_value")), "_row")
    slots = stage(rows.groupBy("_file", "_slot").agg(last.alias("_last"), F.min(F.struct(*whole)).alias("_first")), "slots")
    files = slots.groupBy("_file").agg(F.max_by("_last", "_slot").alias("_last"), F.min("_first").alias("_first"))
    before_file = files.select("_file", F.lag("_last").over(Window.orderBy("_first", "_file")).alias("_earlier"))
    before = slots.join(before_file, "_file").select(
        "_file", "_slot", F.coalesce(F.lag("_last").over(Window.partitionBy("_file").orderBy("_slot")), "_earlier").alias("_carried"))

    def same(column: str, get) -> Column:
        return get(column).eqNullSafe(F.col(column))

    def all_same(get) -> Column:
        matches = same(keys[0], get)
        for key in keys[1:]:
            matches &= same(key, get)
        return matches

    begins = F.col("_row") == F.col("_slot") * slot
    local = rows.withColumns({"_same": all_same(lambda k: F.lag(k).over(inside)), "_near": F.lag(value).over(inside)})
    carried = F.when(all_same(lambda k: F.col(f"_carried.{k}")), F.col("_carried._value"))
    found = F.when(begins, carried).when(F.col("_same"), F.col("_near"))
    return local.join(before, ["_file", "_slot"]).withColumn(name, found).select(*df.columns, name)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows with ``name``, their place from 0 in the order of the whole table.

    Rows are sorted in files by range; a row's number is its place in its file and the rows of the files before, of which
    there is one row each to add up.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), "ranges")
    rows = ranged.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    firsts = rows.filter("_row = 0").join(sizes, "_file")
    earlier = Window.orderBy(*order, "_file").rowsBetween(Window.unboundedPreceding, -1)
    before = firsts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(before, "_file").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))
