"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are written for. Skewed join keys (a popular object) are split by AQE
# also when that costs one more exchange; timestamps are read and printed in UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    app: str = "newsloom", cores: str = "*", partitions: int = 8, memory: str = "8g", **options: str
) -> SparkSession:
    """A single-machine session for tests and benchmarks; ``options`` are further settings, dots as ``__``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in options.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one named in ``spark.checkpoint.dir``.

    Where it is unset, a single-machine session (``local[..]``) uses a temporary folder; any other cluster must
    name one, because executors would each write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_staged: list[str] = []


def stage(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    The table survives lost executors and cuts the lineage, and its real size lets Spark choose the joins
    that follow.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str = "stage") -> DataFrame:
    """:func:`stage` with zstd, for many narrow rows that are read a few times."""
    return stage(df, name, "zstd")


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables staged so far. Call it when the results that read them are written."""
    while _staged:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers, once per Spark context; they import the functions they run from it.

    With ``--py-files`` or the package installed on every node this is not needed, and does no harm.
    """
    context, name = spark.sparkContext, "newsloom-package.zip"
    if name not in context._python_includes:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), name)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, files in os.walk(root):
                for file in files:
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        archive.write(full, os.path.join("newsloom", os.path.relpath(full, root)))
        context.addPyFile(path)
    return spark
