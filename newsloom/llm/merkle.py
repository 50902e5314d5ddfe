"""Merkle manifest of a data set: a digest per row, a tree per source, a tree over the sources.

Where a leaf stands in its source follows from bitmaps of the source's ids: ids that share their upper bits are one word of 64
bits, made by an OR that starts before the shuffle, and a directory holds how many rows stand before each word. The rank of an
id is its word's entry plus the bits set below its own, so leaves are placed without being sorted. Placed leaves go into
arrays of FAN slots, keyed by (source, place / FAN); an array's digest is a slot of the level above, until one is left. Proofs
come back the same way: from the root down, each array hands its slots what stands beside them and above.

All of it are DataFrame operations. A level is a table in the shared folder, a sixteenth of the one below. No group is larger
than FAN slots, DIRECTORY words, or the rows that share an id and all of their columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.packed import part_count
from newsloom.session import stage

FAN = 16
"""Slots of an array: nodes that are hashed together."""
_SHIFT = 4
DIRECTORY = 1 << 16
"""Entries of one directory; where a group has more, a directory of directories stands above."""
_WORD = 6
_DIGIT = 14

# The columns a leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def _hashed(parts: Column) -> Column:
    """Digest of joined digests, whose hex text is what is hashed."""
    return F.unhex(sha256_hex(F.lower(F.hex(parts))))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its text; NULL as a hyphen."""
    return F.unhex(sha256_hex(F.concat(*[_field(f) for f in fields])))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def directory(counted: DataFrame, group: Sequence[str], key: str, entries: int) -> DataFrame:
    """Bitmaps of the keys of each group, with counts: (*group, word, bits, extra, before, size).

    ``counted`` has one row per group and key, and ``n``, how many rows there are of it. A word holds the keys that agree in
    all but the last six bits; ``extra`` has the keys that stand for several rows, ``before`` counts the group's rows with a key
    in an earlier word, ``size`` all of the group's rows. ``entries`` bounds the keys of a group; above DIRECTORY the largest
    number of words a group really has is asked for, the only thing that reaches the driver.
    """
    bit = (F.col(key) % 64 + 64) % 64
    words = stage(
        counted.groupBy(*group, F.shiftright(key, _WORD).alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("bits"),
            F.collect_list(F.when(F.col("n") > 1, F.struct(bit.cast("int").alias("bit"), (F.col("n") - 1).alias("n")))).alias("extra"),
            F.sum("n").alias("n"),
        ), "bitmap")
    levels = [words.withColumnRenamed("word", "node")]
    while entries > DIRECTORY:
        entries = levels[-1].groupBy(*group).count().agg(F.max("count")).first()[0]
        if entries <= DIRECTORY:
            break
        above = levels[-1].groupBy(*group, F.shiftright("node", _DIGIT).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(stage(above, "directory"))
    top = Window.partitionBy(*group)
    earlier = top.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    counts = levels.pop().withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "size": F.sum("n").over(top)})
    while levels:
        above = counts.select(*group, F.col("node").alias("up"), F.col("before").alias("start"), "size")
        earlier = Window.partitionBy(*group, "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        inside = levels.pop().withColumn("up", F.shiftright("node", _DIGIT)).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        counts = inside.join(above, [*group, "up"]).withColumn("before", F.col("before") + F.col("start")).drop("up", "start")
    return counts.withColumnRenamed("node", "word").drop("n")


def ranked(rows: DataFrame, index: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """``rows`` with ``place``, the number of rows of the group with a smaller key, and ``size``, of all its rows.

    A rank query: the entry of the key's word, and the bits below the key's own. Words are unique, so a key or group with
    very many rows is skewed on one side of the join only, which AQE splits.
    """
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    repeats = F.aggregate(F.filter("extra", lambda e: e["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda total, e: total + e["n"])
    asked = rows.withColumns({"word": F.shiftright(key, _WORD), "bit": F.expr(f"cast(pmod({key}, 64) as int)")})
    return asked.join(index, [*group, "word"]).withColumn("place", F.col("before") + below + repeats).drop(
        "word", "bit", "bits", "extra", "before")


_SOURCE = ["source_key"]
_IDS = ["source_key", "with_id"]
"""Rows without an id are a group of their own, before the source's others, so ids keep all of their 64 bits."""


def _among_equal_ids(leaves: DataFrame, keys: DataFrame) -> DataFrame:
    """(source_key, with_id, key, leaf, offset): different leaves with one id, ranked by their digests in bitmaps of their own."""
    group = [*_IDS, "key"]
    prefix = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")
    among = leaves.join(keys.filter("leaves > 1").select(*group), group).withColumn("prefix", prefix)
    # Digests that agree in 60 bits are all but always copies, and those are one row here.
    same = Window.partitionBy(*group, "prefix").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    among = stage(among.withColumn("earlier", F.coalesce(F.sum("n").over(same), F.lit(0))), "tied")
    prefixes = among.groupBy(*group, "prefix").agg(F.sum("n").alias("n"))
    most = among.groupBy(*group).count().agg(F.max("count")).first()[0]
    return ranked(among, directory(prefixes, group, "prefix", most), group, "prefix").select(
        *group, "leaf", (F.col("place") + F.col("earlier")).alias("offset"))


def placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """Distinct ``leaves`` (source_key, with_id, key, leaf, n, ...) with their first place and the size of their source.

    They stand in their source by id, then by leaf. Also the size of the largest source, and the number of sources.
    """
    keys = stage(leaves.groupBy(*_IDS, "key").agg(F.sum("n").alias("n"), F.count("*").alias("leaves")), "keys")
    sizes = keys.groupBy(*_SOURCE).agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("with_id"), 0).otherwise(F.col("n"))).alias("lost"),
        F.count("*").alias("entries"), F.max("leaves").alias("leaves"))
    most = sizes.agg(F.max("all"), F.count("*"), F.max("lost"), F.max("entries"), F.max("leaves")).first()
    spots = ranked(leaves, directory(keys, _IDS, "key", most[3] or 0), _IDS, "key")
    if (most[4] or 0) > 1:
        offsets = _among_equal_ids(leaves, keys)
        spots = spots.join(offsets, [*_IDS, "key", "leaf"], "left").withColumn("place", F.col("place") + F.coalesce("offset", F.lit(0)))
    if most[2]:
        spots = spots.join(sizes.select(*_SOURCE, "all", "lost"), _SOURCE).withColumns({
            "place": F.col("place") + F.when(F.col("with_id"), F.col("lost")).otherwise(0), "size": F.col("all")})
    return spots, most[0] or 0, most[1]


def _level(nodes: DataFrame, group: Sequence[str], *carried: str) -> DataFrame:
    """Arrays of FAN slots: (*group, at, size, slots, digest); ``size`` counts the nodes of the group on this level."""
    slot = F.struct((F.col("place") % FAN).cast("int").alias("slot"), "digest", *carried)
    arrays = nodes.groupBy(*group, F.shiftright("place", _SHIFT).alias("at")).agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(slot)).alias("slots"))
    return arrays.withColumn("digest", F.when(F.col("size") > 1, _hashed(_digests(F.col("slots")))).otherwise(F.col("slots")[0]["digest"]))


def _digests(slots: Column) -> Column:
    return F.aggregate(slots, F.lit(b""), lambda all_, s: F.concat(all_, s["digest"]))


def _up(levels: list[DataFrame], group: Sequence[str], name: str, largest: int) -> None:
    """Add level after level to the leaf arrays until every group is one node. ``largest``: leaves of the largest group."""
    while largest > FAN:
        largest = -(-largest // FAN)
        nodes = levels[-1].filter(F.col("size") > FAN).select(
            *group, F.col("at").alias("place"), "digest", F.ceil(F.col("size") / FAN).cast("long").alias("size"))
        levels.append(stage(_level(nodes, group), name))


def _tops(levels: list[DataFrame], group: Sequence[str]) -> DataFrame:
    """(*group, digest) of the groups' last arrays."""
    tops = [level.filter(F.col("size") <= FAN).select(*group, "digest") for level in levels]
    for more in tops[1:]:
        tops[0] = tops[0].unionByName(more)
    return tops[0]


_STEP = "array<struct<left:binary,right:binary>>"


def _slots(arrays: DataFrame, kept: Sequence[str], *carried: str) -> DataFrame:
    """A row per slot, with its path: what stands left and right of it, then the array's own path.

    An array that is all of its group with one node alone adds no step.
    """
    left = F.filter("slots", lambda s: s["slot"] < F.col("one.slot"))
    right = F.filter("slots", lambda s: s["slot"] > F.col("one.slot"))
    step = F.array(F.struct(_digests(left).alias("left"), _digests(right).alias("right")))
    path = F.when(F.col("size") > 1, F.concat(step, "path")).otherwise(F.col("path"))
    return arrays.withColumn("one", F.explode("slots")).select(
        *kept, (F.col("at") * FAN + F.col("one.slot")).alias("place"), F.col("one.digest").alias("digest"),
        *[F.col(f"one.{c}").alias(c) for c in carried], path.alias("path"))


def _down(levels: list[DataFrame], group: Sequence[str], start: DataFrame, kept: Sequence[str], *carried: str) -> DataFrame:
    """The nodes under the lowest arrays with their paths. ``start`` has the path above each group (*kept, path)."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        first = levels[k].filter(F.col("size") <= FAN)
        whole = first.join(start, group) if group else first.crossJoin(F.broadcast(start))  # one array and one row
        if paths is not None:
            above = paths.select(*kept, F.col("place").alias("at"), "path")
            whole = whole.unionByName(levels[k].filter(F.col("size") > FAN).join(above, [*group, "at"]))
        paths = _slots(whole, kept, *carried) if k == 0 else stage(_slots(whole, kept), "paths")
    return paths


def _numbered(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows with ``place`` from 0 by ``order``; many are ranges in files, and the rows of the files before."""
    if n <= DIRECTORY:
        return df.withColumn("place", F.row_number().over(Window.orderBy(order)).cast("long") - 1)
    ranged = stage(df.repartitionByRange(part_count(df.sparkSession), order).sortWithinPartitions(order), "numbered")
    rows = ranged.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = rows.groupBy("file").agg(F.min(order).alias("least"), F.count("*").alias("n"))
    earlier = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    before = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "file").select(*df.columns, (F.col("before") + F.col("row")).alias("place"))


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row of (doc_id, source, lang, n_chars, text): doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    Digests are lower-case hex; ``path`` has for each level from the leaf to the root the digests left and right of the row's
    node. ``tampered`` is the text as it is later found, an expression on the input's columns (by default the text itself):
    ``folded_root`` is made of the leaf with that text and the stored siblings, and ``verified`` says whether it is the root.

    Leaves of a source stand by doc_id, NULL before all others, and leaves with one id by their digest. Repeated rows are leaves
    of their own; where they are equal, which copy has which place does not matter. A NULL source is a source of its own,
    before all others, an empty one comes next. Columns not named are ignored. No rows give no rows.
    """
    text = F.col("text").cast("string")
    changed = text if tampered is None else tampered.cast("string")
    fields = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), fields[1]), F.lit("")).alias("source_key"),  # sorts as the source does, and has no NULL
        F.coalesce(fields[0], F.lit(0).cast("long")).alias("key"), fields[0].isNotNull().alias("with_id"),
        leaf_digest(*fields, text).alias("leaf"),
        F.when(~text.eqNullSafe(changed), leaf_digest(*fields, changed)).alias("found"),
    )
    leaves = stage(rows.groupBy(*_IDS, "key", "leaf").agg(F.count("*").alias("n"), F.max("found").alias("found")), "leaves")
    spots, largest, sources = placed(leaves)
    nodes = spots.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "source_key", (F.col("place") + F.col("copy")).alias("place"), "size", F.col("leaf").alias("digest"),
        F.when(F.col("with_id"), F.col("key")).alias("doc_id"), "found")
    trees = [stage(_level(nodes, _SOURCE, "doc_id", "found"), "arrays")]
    _up(trees, _SOURCE, "arrays", largest)
    subroots = _numbered(_tops(trees, _SOURCE), "source_key", sources).withColumn("size", F.lit(sources).cast("long"))
    forest = [stage(_level(subroots, [], "source_key"), "sources")]
    _up(forest, [], "sources", sources)
    root = _tops(forest, []).select(F.col("digest").alias("root"), F.array().cast(_STEP).alias("path"))
    above = _down(forest, [], root, ["root"], "source_key").withColumnRenamed("digest", "subroot")
    start = stage(above.select("source_key", "subroot", "root", "path"), "paths")
    proofs = _down(trees, _SOURCE, start, ["source_key", "subroot", "root"], "doc_id", "found")
    folded = F.aggregate("path", F.coalesce("found", "digest"), lambda node, s: _hashed(F.concat(s["left"], node, s["right"])))
    siblings = F.aggregate("path", F.lit(b""), lambda all_, s: F.concat(all_, s["left"], s["right"]))

    def shown(digest: str) -> Column:
        return F.lower(F.hex(digest))

    return proofs.withColumn("folded", folded).select(
        "doc_id", F.when(F.col("source_key") != "", F.substring("source_key", 2, 1 << 30)).alias("source"),
        shown("digest").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"),
        sha256_hex(F.lower(F.hex(siblings))).alias("proof_sha256"), shown("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"), "path")
