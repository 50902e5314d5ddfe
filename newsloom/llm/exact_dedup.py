"""Exact deduplication against a digest index that lasts from batch to batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.llm.packed import part_count
from newsloom.session import stage

BLANK = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


class DigestIndex:
    """A table (digest, keep_id), bucketed and sorted by digest.

    A batch is reduced to one row per digest, joined to the index by a sort-merge anti join that does not move the
    index, and what is new is appended in the index's own buckets. One key never has more than one row on either
    side, so a text with any share of all rows costs one row per task.

    Adding the same batch again changes nothing, and appends are committed as a whole, so a failed batch is added
    again. Batches are added one after the other: the table has one writer. A new index has ``buckets``, by default as many
    as a shuffle has partitions; one that has become too large for them is dealt out again by :meth:`rebuild`.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        if spark.catalog.tableExists(self.table):
            described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {self.table}").collect()}
            self.buckets = int(described["Num Buckets"])
        else:
            self.buckets = buckets or part_count(spark)
            self._write(spark.createDataFrame([], "digest binary, keep_id long"), self.table)

    def _write(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)

    def rebuild(self, buckets: int) -> None:
        """The same digests in another number of buckets; the old table goes when the new one is whole."""
        self.buckets, new = buckets, f"{self.table}_{uuid.uuid4().hex}"
        self._write(self.read().repartition(buckets, "digest"), new)
        self.drop()
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.table}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame) -> None:
        """Append the digests of (digest, doc_id) that the index lacks, each with its smallest id."""
        new = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        self._write(new.join(self.read().hint("merge"), "digest", "left_anti"), self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _groups(docs: DataFrame, index: DigestIndex) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc_id, digest), and a row per text (digest, group_size, keep_id); the batch is in the index then.

    Both are written out: rows meet their text in a join of two plain exchanges, of which AQE splits the hot side.
    """
    digests = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")
    ), "digests")
    # Reduced and written before the index is asked: Spark would move an anti join below the aggregate, to all rows of a text.
    sizes = stage(digests.groupBy("digest").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("doc_id")), "sizes")
    index.add(sizes)
    return digests, stage(sizes.drop("doc_id").join(index.read(), "digest"), "groups")


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Each row of (doc_id, text) with the decision about it: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white-space runs became one space; NULL is the empty text. The row
    with the smallest id stays, or the row an earlier batch put into the index. ``group_size`` counts the rows of this
    batch. Repeated rows with the id that stays are all kept; a NULL id stays only where no equal text has an id.
    Other columns are ignored.
    """
    digests, groups = _groups(docs, index)
    return digests.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows that stay, with all their columns; repeated rows of an id with one text are one row.

    The decisions are written out, so the index is not needed any more when this returns.
    """
    decided = _groups(docs, index)[1].select(F.col("keep_id").alias("id"), F.lower(F.hex("digest")).alias("digest"))
    # the input's own columns go by number meanwhile, so none of them can clash
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(name)}") for name in ("doc_id", "text"))
    keyed = numbered.withColumns({"own_id": doc_id.cast("long"), "own_digest": F.sha2(normalised(text), 256)})
    kept = keyed.join(decided, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_digest"]).drop("own_id", "own_digest").toDF(*docs.columns)
