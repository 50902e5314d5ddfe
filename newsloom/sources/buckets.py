"""Stored tables dealt into folders by the hash of a key, of which a job opens the folders its own keys fall into."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsloom.session import packed


class BucketTable:
    """A table under ``path`` with ``buckets`` folders by hash of ``key``; an existing one keeps the number it has.

    A merge reads the folders of its keys and replaces them, so its work follows the keys and not the table. It is written out
    before it replaces anything; a merge that fails while replacing is repeated, and has to give the same rows again. One
    writer at a time; a reader during a merge may find folders of before and after it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.key, self.schema = spark, key, StructType.fromDDL(schema)
        self._parent = path.rstrip("/")
        counts = [int(m[1]) for name in self._names(self._parent) if (m := re.fullmatch(r"of-(\d+)", name))]
        self.buckets = max(counts, default=buckets)

    @property
    def path(self) -> str:
        return f"{self._parent}/of-{self.buckets}"

    def _system(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, system = self._system(path)
        return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> list[int]:
        return sorted(int(m[1]) for name in self._names(self.path) if (m := re.fullmatch(r"bucket=(\d+)", name)))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some folders; no others are listed or opened."""
        some = [b for b in self._stored() if buckets is None or b in set(buckets)]
        if not some:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/bucket={b}" for b in some])

    def touched(self, keys: DataFrame) -> list[int]:
        """The folders that keys (one column) fall into: at most ``buckets`` numbers reach the driver."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0]))).distinct().collect())

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """Put ``rows``, which fall into ``buckets``, in place of what these folders hold."""
        names = self.schema.names
        done = packed(rows.select(*names).withColumn("bucket", self.bucket(F.col(self.key))), "buckets")
        # the hint lets AQE split a folder with a large share of the rows
        laid_out = done.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
        laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path, compression="zstd")
        filled = {r[0] for r in done.select("bucket").distinct().collect()}
        for b in set(buckets) - filled:
            folder, system = self._system(f"{self.path}/bucket={b}")
            system.delete(folder, True)

    def rebuild(self, buckets: int) -> None:
        """Deal all rows into another, larger number of folders; the old ones go when the new ones are whole."""
        if buckets <= self.buckets:
            raise ValueError("a table is rebuilt with more buckets")
        rows, old = packed(self.read(), "buckets"), self.path
        self.buckets = buckets
        self.replace(rows, list(range(buckets)))
        folder, system = self._system(old)
        system.delete(folder, True)
