"""Table schemas, physical layout and document contracts."""

from __future__ import annotations

from pyspark.sql import types as T


# Names, types and required columns of the stored tables.
OBJECTS = (
    T.StructType()
    .add("id", "string", False)
    .add("source", "string", False)
    .add("published", "timestamp", False)
    .add("updated", "timestamp")
    .add("tags", T.ArrayType(T.StringType(), False))
    .add("tags_enriched", "boolean", False)
    .add("og_enriched", "boolean", False)
    .add("og_enriched_error", "string")
    .add("like_count", "long", False)
    .add("dislike_count", "long")
    .add("deleted", "boolean", False)
    .add("object_json", "string")
)
ACTIVITIES = (
    T.StructType()
    .add("id", "string", False)
    .add("type", "string", False)
    .add("actor", "string", False)
    .add("object_id", "string")
    .add("object_type", "string")
    .add("object_json", "string")
    .add("target_id", "string")
    .add("in_reply_to", "string")
    .add("thread_root", "string")
    .add("published", "timestamp", False)
    .add("received_at", "timestamp", False)
)
LIKES = (
    T.StructType()
    .add("activity_id", "string", False)
    .add("actor", "string", False)
    .add("object_id", "string", False)
    .add("reaction_type", "string", False)
    .add("published", "timestamp", False)
)
CONFIG = (
    T.StructType()
    .add("key", "string", False)
    .add("value", "string", False)
    .add("updated_at", "timestamp", False)
    .add("updated_by", "string")
)
FEEDS = (
    T.StructType()
    .add("name", "string", False)
    .add("url", "string", False)
    .add("autodiscover", "boolean")
)
LEXICON = (
    T.StructType()
    .add("token", "string", False)
    .add("baseform", "string", False)
    .add("class", "string")
)
PUBLISHERS = (
    T.StructType()
    .add("source", "string", False)
    .add("name", "string", False)
    .add("url", "string")
)
REQUESTS = (
    T.StructType()
    .add("request_id", "string", False)
    .add("type", "string")
    .add("actor", "string", False)
    .add("object_id", "string")
    .add("object_json", "string")
    .add("received_at", "timestamp", False)
)

TABLES = {
    "objects": OBJECTS,
    "activities": ACTIVITIES,
    "likes": LIKES,
    "config": CONFIG,
    "feeds": FEEDS,
    "lexicon": LEXICON,
    "publishers": PUBLISHERS,
}

# Tables partitioned by the UTC date of `published`, and the columns rows are sorted by inside a file.
CLUSTERING = {
    "objects": ["source", "published"],
    "activities": ["type", "actor"],
    "likes": ["object_id", "actor"],
}

# Columns a live objects table must have.
OBJECTS_CONTRACT = [
    "id", "source", "published", "updated", "object_json", "tags", "tags_enriched", "like_count", "deleted",
]

# Keys each document type must carry.
DOCUMENT_CONTRACTS = {
    "Article": ["@context", "type", "id", "name", "url", "published"],
    "Note": ["@context", "type", "id", "content", "published", "attributedTo", "inReplyTo"],
    "OrderedCollection": ["@context", "type", "id", "totalItems", "orderedItems"],
    "Hashtag": ["type", "name"],
}
