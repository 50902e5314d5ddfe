"""Tables whose changes of one run become visible together.

Each run writes into folders of its own and never into those of an earlier one. A manifest says which run holds each date of a
dated table and each other table; it is put in place as the last step, in one move. Until then readers see what the run
before left, whatever the run has written; a run that stopped is simply done again. One writer at a time.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsloom.sources.tables import laid_out, with_published_date


@dataclass
class Manifest:
    """``dated``: run by date of each table that is partitioned by publication date; ``whole``: run of the others."""

    run: int = -1
    dated: dict[str, dict[str, int]] = field(default_factory=dict)
    whole: dict[str, int] = field(default_factory=dict)


class Store:
    """The tables under a folder, as the newest manifest has them."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def _system(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, system = self._system(path)
        return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []

    def manifest(self, back: int = 0) -> Manifest:
        """The newest manifest, or one ``back`` from it."""
        runs = sorted(int(m[1]) for name in self._names(f"{self.root}/manifests") if (m := re.fullmatch(r"(\d+)\.json", name)))
        if len(runs) <= back:
            return Manifest()
        text = self.spark.read.text(f"{self.root}/manifests/{runs[-1 - back]}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def read(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """A table; a dated one has its ``published_date``, by which the scan is pruned."""
        manifest = manifest or self.manifest()
        if name in manifest.whole:
            return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}/run={manifest.whole[name]}")
        dates = manifest.dated.get(name)
        if not dates:
            empty = self.spark.createDataFrame([], self.schemas[name])
            return with_published_date(empty) if dates is not None else empty
        typed = StructType([*self.schemas[name].fields]).add("run", "integer").add("published_date", "date")
        paths = [f"{self.root}/{name}/run={run}/published_date={day}" for day, run in sorted(dates.items())]
        return self.spark.read.schema(typed).option("basePath", f"{self.root}/{name}").parquet(*paths).drop("run")

    def begin(self) -> Run:
        return Run(self, self.manifest())

    def vacuum(self) -> None:
        """Delete run folders that neither of the two newest manifests names."""
        kept = [self.manifest(), self.manifest(1)]
        for name in self.schemas:
            used = {run for m in kept for run in [*m.dated.get(name, {}).values(), *([m.whole[name]] if name in m.whole else [])]}
            for folder in self._names(f"{self.root}/{name}"):
                if (m := re.fullmatch(r"run=(\d+)", folder)) and int(m[1]) not in used:
                    path, system = self._system(f"{self.root}/{name}/{folder}")
                    system.delete(path, True)


class Run:
    """Changes on top of a manifest. Nothing of them shows until :meth:`commit`."""

    def __init__(self, store: Store, before: Manifest):
        self.store, self.before = store, before
        self.after = Manifest(before.run + 1, {name: dict(dates) for name, dates in before.dated.items()}, dict(before.whole))

    def _folder(self, name: str) -> str:
        return f"{self.store.root}/{name}/run={self.after.run}"

    def read(self, name: str) -> DataFrame:
        return self.store.read(name, self.before)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a table as a whole."""
        rows.write.mode("overwrite").parquet(self._folder(name))
        self.after.whole[name] = self.after.run

    def rewrite(self, name: str, rows: DataFrame, dates: list[date]) -> None:
        """Write the rows of some publication dates (those the rows now have and those they had); other dates stay."""
        dated = laid_out(rows if "published_date" in rows.columns else with_published_date(rows), name)
        dated.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("published_date").parquet(self._folder(name))
        table = self.after.dated.setdefault(name, {})
        for day in dates:
            table.pop(str(day), None)
        for folder in self.store._names(self._folder(name)):
            if m := re.fullmatch(r"published_date=([0-9-]+)", folder):
                table[m[1]] = self.after.run

    def commit(self) -> None:
        """Put the manifest in place: written under another name and renamed."""
        folder = f"{self.store.root}/manifests"
        part, system = self.store._system(f"{folder}/{self.after.run}.part")
        stream = system.create(part, True)
        stream.write(bytearray(json.dumps(self.after.__dict__).encode()))
        stream.close()
        if not system.rename(part, self.store._system(f"{folder}/{self.after.run}.json")[0]):
            raise RuntimeError(f"run {self.after.run} was committed by another writer")
