"""Change tables of streaming jobs: a run of files per micro-batch, folded level by level.

A run is a folder named after the versions it covers. Micro-batch 7 writes ``run=7-7``; eight neighbouring runs of one size
are folded into one that covers them all, so what a reader opens grows with the logarithm of the number of micro-batches. A run
counts once it is committed as a whole, and a run that lies inside another one does not count any more: a crash at any
moment leaves either the small runs or the large one. A replayed micro-batch replaces its own run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

FAN = 8
Fold = Callable[[DataFrame], DataFrame]
Run = tuple[int, int]


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str) -> list[Run]:
    folder, system = _files(spark, path)
    if not system.exists(folder):
        return []
    runs = []
    for status in system.listStatus(folder):
        name = re.fullmatch(r"run=(\d+)-(\d+)", status.getPath().getName())
        if name and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            runs.append((int(name[1]), int(name[2])))
    return sorted(runs)


def _inside(run: Run, runs: Sequence[Run]) -> bool:
    return any(other != run and other[0] <= run[0] and run[1] <= other[1] for other in runs)


def live_runs(spark: SparkSession, path: str) -> list[Run]:
    """The runs that count, in order: committed ones that no other covers."""
    runs = _committed(spark, path)
    return [run for run in runs if not _inside(run, runs)]


def _write(rows: DataFrame, path: str, run: Run) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/run={run[0]}-{run[1]}")


def write_version(changes: DataFrame, path: str, version: int) -> None:
    """Write the changes of one micro-batch; writing the same version again replaces it."""
    if _inside((version, version), _committed(changes.sparkSession, path)):
        return  # a replay of what is folded already
    _write(changes.withColumn("version", F.lit(version).cast("long")), path, (version, version))


def read_versions(
    spark: SparkSession, path: str, schema: StructType, before: int | None = None, since: int | None = None
) -> DataFrame:
    """Changes with their ``version``; ``before`` leaves out that version and later ones, ``since`` those up to it.

    Whole runs outside these bounds are not opened.
    """
    typed = StructType([*schema.fields, StructField("version", LongType())])
    runs = [r for r in live_runs(spark, path) if (before is None or r[0] < before) and (since is None or r[1] > since)]
    if not runs:
        return spark.createDataFrame([], typed)
    changes = spark.read.schema(typed).parquet(*[f"{path}/run={a}-{b}" for a, b in runs])
    if before is not None:
        changes = changes.filter(F.col("version") < before)
    return changes if since is None else changes.filter(F.col("version") > since)


def newest(*keys: str) -> Fold:
    """Fold to the newest version of each key."""

    def fold(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("row"))
        return best.select(*[F.col(c) if c in keys else F.col(f"row.{c}") for c in rows.columns])

    return fold


def summed(keys: Sequence[str], values: Sequence[str]) -> Fold:
    """Fold to sums per key, under the newest version among them."""

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values], F.max("version").alias("version")).select(*rows.columns)

    return fold


def compact(spark: SparkSession, path: str, schema: StructType, fold: Fold, fan: int = FAN) -> None:
    """Fold neighbouring runs of one size wherever there are ``fan`` of them, and drop what earlier folds have covered.

    The newest run stays as it is: its micro-batch may still be replayed. Runs covered by a fold of this call are dropped by
    the next one, so a reader that has listed them can finish. The table has one writer, the job that calls this.
    """
    runs = _committed(spark, path)
    for run in runs:
        if _inside(run, runs):
            folder, system = _files(spark, f"{path}/run={run[0]}-{run[1]}")
            system.delete(folder, True)
    while True:
        old = live_runs(spark, path)[:-1]
        size = fan
        group: list[Run] = []
        while old and size <= max(b - a + 1 for a, b in old) * fan:
            # runs of the level below, without a gap between them
            small = [r for r in old if r[1] - r[0] + 1 == size // fan]
            chains = [small[i:i + fan] for i in range(len(small) - fan + 1)]
            group = next((c for c in chains if c[-1][1] - c[0][0] + 1 == size), [])
            if group:
                break
            size *= fan
        if not group:
            return
        typed = StructType([*schema.fields, StructField("version", LongType())])
        rows = spark.read.schema(typed).parquet(*[f"{path}/run={a}-{b}" for a, b in group])
        _write(fold(rows), path, (group[0][0], group[-1][1]))
