"""Document contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.documents import keys, text_field
from newsloom.functions.rows import pinned
from newsloom.schemas import DOCUMENT_CONTRACTS


def missing_keys(present: Column, kind: Column) -> Column:
    """Keys a type of document requires and that are not present, in the contract's order."""
    result = F.lit(None).cast("array<string>")
    for name, required in DOCUMENT_CONTRACTS.items():
        wanted = F.array(*[F.lit(key) for key in required])
        result = F.when(kind == name, F.array_except(wanted, present)).otherwise(result)
    return result


def validate_documents(objects: DataFrame) -> DataFrame:
    """(id, kind, problem, missing) for every object whose document breaks its contract."""
    read = objects.select(
        "id", F.col("object_json").isNull().alias("absent"), text_field(F.col("object_json"), "type").alias("kind"),
        keys(F.col("object_json")).alias("present"),
    )
    once = pinned(read, "kind", "present")
    checked = once.withColumn("missing", missing_keys(F.col("present"), F.col("kind")))
    problem = (
        F.when(F.col("absent"), "no document")
        .when(F.size("present") == 0, "not a JSON object")
        .when(F.col("kind").isNull(), "no type")
        .when(F.col("missing").isNull(), "unknown type")
        .when(F.size("missing") > 0, "missing keys")
    )
    return checked.select("id", "kind", problem.alias("problem"), "missing").filter(F.col("problem").isNotNull())
