"""The latest activity of every thread, kept up to date from the rows of the log that are new.

The log says when something arrived at an object and which thread that belongs to; a deletion takes back everything its object
did, whenever it arrived. Kept are one entry per object and thread with its latest arrival, and the deleted objects. New rows
raise entries; a new deletion retracts its object's entries, and the threads they belonged to, no others, are
looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.session import stage
from newsloom.sources.buckets import BucketTable

ENTRIES = "root string, object_id string, last_activity_at timestamp"
OBJECTS = "object_id string, root string, deleted boolean"


def reduced(activities: DataFrame) -> DataFrame:
    """(object_id, root, last_activity_at): one row per object and thread, and one with a NULL root per deleted object.

    Reduced before the shuffle, so a popular object is a row per task.
    """
    touching = F.col("type").isin("Like", "Dislike", "Create")
    root = F.when(touching, F.coalesce("thread_root", "object_id"))
    relevant = activities.filter((touching | (F.col("type") == "Delete")) & F.col("object_id").isNotNull())
    return relevant.groupBy("object_id", root.alias("root")).agg(
        F.max(F.when(touching, F.col("received_at")).cast("timestamp")).alias("last_activity_at"))


@dataclass
class Recency:
    """The stored entries: by thread, and by object which threads it is in and whether it is deleted."""

    entries: BucketTable
    objects: BucketTable

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 64) -> Recency:
        return cls(BucketTable(spark, f"{path}/entries", "root", ENTRIES, buckets), BucketTable(spark, f"{path}/objects", "object_id", OBJECTS, buckets))

    def advance(self, fresh: DataFrame) -> DataFrame:
        """Take in new rows of the log: (id, last_activity_at) of every thread they touch, NULL where nothing is left.

        Reads and writes the folders of the objects in ``fresh`` and of the threads these touch. Taking the same rows in again
        changes nothing, so a run that failed is repeated.
        """
        new = stage(reduced(fresh), "recency-new")
        mine = self.objects.touched(new.select("object_id"))
        known = stage(self.objects.read(mine), "recency-known")
        dead = new.filter("root is null").select("object_id").union(known.filter("deleted").select("object_id")).distinct()
        # threads to look at: of new rows, and of everything the newly deleted objects were in
        gone = new.filter("root is null").select("object_id").join(known.filter("deleted").select("object_id"), "object_id", "left_anti")
        roots = stage(
            new.filter("root is not null").select("root").union(known.filter("root is not null").join(gone, "object_id", "left_semi").select("root")).distinct(),
            "recency-roots")
        theirs = self.entries.touched(roots)
        names = ["root", "object_id", "last_activity_at"]
        both = self.entries.read(theirs).unionByName(new.filter("root is not null").select(*names))
        merged = both.groupBy("root", "object_id").agg(F.max("last_activity_at").alias("last_activity_at"))
        kept = stage(merged.join(dead, "object_id", "left_anti").select(*names), "recency-entries")
        self.entries.replace(kept, theirs)
        # objects last: until they are written, a repeated run finds the same deletions new
        pairs = new.select("object_id", "root", F.col("root").isNull().alias("deleted"))
        self.objects.replace(known.unionByName(pairs).distinct(), mine)
        last = kept.join(roots, "root", "left_semi").groupBy("root").agg(F.max("last_activity_at").alias("last_activity_at"))
        return roots.join(last, "root", "left").select(F.col("root").alias("id"), "last_activity_at")

    def last_activity(self) -> DataFrame:
        """(id, last_activity_at) of all threads, as reactions.last_activity computes it from the whole log."""
        return self.entries.read().groupBy(F.col("root").alias("id")).agg(F.max("last_activity_at").alias("last_activity_at"))
