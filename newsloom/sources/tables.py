"""Parquet tables: reading, laying out, appending and checking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.schemas import CLUSTERING, OBJECTS_CONTRACT, TABLES
from newsloom.session import stage


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table; the scan reads only the columns the query uses."""
    table = spark.read.parquet(f"{root}/{name}")
    return table.select(*columns) if columns else table


def with_published_date(df: DataFrame) -> DataFrame:
    """Add the partition column."""
    return df.withColumn("published_date", F.to_date("published"))


def laid_out(df: DataFrame, name: str) -> DataFrame:
    """Rows brought together by publication date and sorted by the table's clustering columns.

    The rebalance hint lets AQE split a date that holds a large share of the rows and join small ones, so
    files come out even and no task writes a whole hot date.
    """
    if name not in CLUSTERING:
        return df
    dated = df if "published_date" in df.columns else with_published_date(df)
    return dated.hint("rebalance", "published_date").sortWithinPartitions("published_date", *CLUSTERING[name])


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Write a new copy of a table. A merge result goes to a new root, never over the table it reads."""
    writer = laid_out(df, name).write.mode(mode)
    if name in CLUSTERING:
        writer = writer.partitionBy("published_date")
    writer.parquet(f"{root}/{name}")


def append_activities(df: DataFrame, root: str) -> None:
    """Add rows to the event log."""
    write_table(df, root, "activities", mode="append")


def touched_dates(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Distinct publication dates a merge can change: those of matched target rows and of the source rows."""
    matched = target.select(key, "published_date").join(source.select(key), key, "left_semi").select("published_date")
    dates = matched.union(with_published_date(source).select("published_date")) if "published" in source.columns else matched
    return dates.distinct()


def rewrite_touched(
    spark: SparkSession, root: str, name: str, source: DataFrame, update: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id"
) -> None:
    """Merge ``source`` into a stored table and write the partitions the merge can change, no others.

    ``update(rows, source)`` gets the rows of the touched dates and returns them merged. The result is written out to
    the shared folder first and then replaces those partitions, so a run that fails before leaves the table as it was,
    and one that fails while replacing is repeated with the same result. The table has one writer at a time.
    """
    source = stage(source, "merge-source")
    stored = read_table(spark, root, name)
    dates = stage(touched_dates(stored, source, key), "merge-dates")
    # a row per date: a table has as many partitions as it has days, and the join prunes the scan by them
    rows = stored.join(F.broadcast(dates), "published_date", "left_semi").drop("published_date")
    merged = stage(with_published_date(update(rows, source)), "merge-result")
    laid_out(merged, name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("published_date").parquet(f"{root}/{name}")
    emptied = dates.join(merged.select("published_date").distinct(), "published_date", "left_anti").filter("published_date IS NOT NULL")
    for date in [row[0] for row in emptied.collect()]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/published_date={date}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table's fixed schema, cast to its types; missing nullable columns become NULL."""
    fields = TABLES[name]
    missing = [f.name for f in fields if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: required columns missing: {missing}")
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in fields]
    )


def null_violations(df: DataFrame, name: str) -> DataFrame:
    """One row: how many rows miss each required column."""
    return df.agg(
        *[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in TABLES[name] if not f.nullable and f.name in df.columns]
    )


def check_contract(df: DataFrame, name: str = "objects") -> list[str]:
    """Problems of a table's shape: missing or mistyped columns, no partition column. Reads no data."""
    expected = {field.name: field.dataType for field in TABLES[name]}
    required = OBJECTS_CONTRACT if name == "objects" else [f.name for f in TABLES[name] if not f.nullable]
    found = {field.name: field.dataType for field in df.schema}
    problems = [f"missing column {column}" for column in required if column not in found]
    problems += [
        f"column {column} is {found[column].simpleString()}, not {kind.simpleString()}"
        for column, kind in expected.items()
        if column in found and not _same_kind(found[column].simpleString(), kind.simpleString())
    ]
    if name in CLUSTERING and "published_date" not in found:
        problems.append("not partitioned by publication date")
    return problems


def _same_kind(found: str, expected: str) -> bool:
    return found == expected or {found, expected} == {"timestamp", "timestamp_ntz"}
