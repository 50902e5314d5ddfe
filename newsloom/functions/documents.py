"""Reading, building and editing the JSON documents stored with objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.times import rfc3339

CONTEXT = "https://www.w3.org/ns/activitystreams"


def text_field(document: Column, *path: str) -> Column:
    """A field as text; an object or array value comes back as its JSON text."""
    return F.get_json_object(document, "$." + ".".join(path))


def keys(document: Column) -> Column:
    """Top-level keys; empty when there is no readable object."""
    return F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))


def parsed(document: Column) -> Column:
    """Top-level keys with values of any type, NULL when the text is not a JSON object."""
    return F.from_json(document, "map<string,variant>")


def null_value() -> Column:
    return F.parse_json(F.lit("null"))


def with_fields(df: DataFrame, document: str, fields: dict[str, Column], out: str | None = None) -> DataFrame:
    """Set top-level fields of a document column; a NULL value leaves the field as it is, other keys are kept.

    The result replaces the column or goes to ``out``. The document and the new values are columns of their
    own first, so each is computed once.
    """
    new = {name: f"_new_{place}" for place, name in enumerate(fields)}
    read = df.withColumns(
        {"_parsed": parsed(F.col(document))} | {new[name]: value.cast("variant") for name, value in fields.items()}
    )
    values = [
        part for name, column in new.items() for part in (F.lit(name), F.coalesce(F.col(column), F.col("_parsed")[name]))
    ]
    given = F.map_filter(F.create_map(*values), lambda _, value: value.isNotNull())
    kept = F.map_filter("_parsed", lambda key, _: ~key.isin(*fields))
    return read.withColumn(out or document, F.to_json(F.map_concat(kept, given))).drop("_parsed", *new.values())


def with_live_fields(df: DataFrame, document: str, out: str) -> DataFrame:
    """What readers see: the stored document with the row's like count and update time."""
    return with_fields(df, document, {"likes": F.col("like_count"), "updated": rfc3339(F.col("updated"))}, out)


def article_document(
    *, id: Column, url: Column, name: Column, summary: Column, published: Column, updated: Column,
    author: Column, author_url: Column, image_url: Column,
) -> Column:
    """Article document; without an image there is no image key."""
    image = F.when(
        image_url.isNotNull() & (image_url != ""),
        F.struct(F.lit("Image").alias("type"), image_url.alias("url")),
    )
    return F.to_json(
        F.struct(
            F.lit(CONTEXT).alias("@context"),
            F.lit("Article").alias("type"),
            id.alias("id"),
            url.alias("url"),
            name.alias("name"),
            summary.alias("summary"),
            published.alias("published"),
            updated.alias("updated"),
            F.struct(
                F.lit("Organization").alias("type"), author.alias("name"), author_url.alias("url")
            ).alias("attributedTo"),
            image.alias("image"),
        )
    )
