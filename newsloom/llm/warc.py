"""WARC archives of web pages, and a normaliser for archives written as one gzip stream.

A file that is one gzip stream can only be read from its beginning. The normaliser inflates such a file once, writes each
record as a gzip member of its own and a sidecar index of the members, so that any record can be read alone. Files are
written under names of their own and count only when the task that wrote them is committed to the manifest; what a lost
task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from newsloom.session import shared_folder, stage

ARCHIVE_BYTES = 64 << 20
MIN_BYTES = 0
READ = 1 << 20
_GZIP = 31
_MANIFEST = "path string, index string, records long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record: a response, or a revisit (without the payload) when ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record of an uncompressed stream; one record is held at a time."""
    buffer = bytearray()

    def more() -> bool:
        chunk = next(chunks, None)
        if chunk is not None:
            buffer.extend(chunk)
        return chunk is not None

    while True:
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(buffer) - 3)
            if not more():
                if bytes(buffer).strip():
                    raise ValueError("the archive ends inside a record's head")
                return
        head = bytes(buffer[:end])
        length = int(parsed(head)["content-length"])
        while len(buffer) < end + 8 + length:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(buffer[end + 4:end + 4 + length])
        del buffer[:end + 8 + length]


def inflated(source, name: str = "archive", size: int = READ) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, piece by piece; zeros after the last member are padding.

    A file that is cut off, or has something else between members, is an error: what is missing can't be told.
    """
    engine = None
    while data := source.read(size):
        while data:
            if engine is None:
                data = data.lstrip(b"\0")
                if not data:
                    break
                engine = zlib.decompressobj(_GZIP)
            try:
                while data and not engine.eof:
                    if piece := engine.decompress(data, size):
                        yield piece
                    data = engine.unconsumed_tail or engine.unused_data
            except zlib.error as error:
                raise ValueError(f"{name}: not a gzip file, or damaged: {error}") from error
            if engine.eof:
                engine = None
    if engine is not None:
        while piece := engine.flush(size):
            yield piece
        if not engine.eof:
            raise ValueError(f"{name}: cut off inside a gzip member")


class _Stream:
    """A file that is one gzip stream."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self.count, self.size = path, 0, 0
        self._out, self._engine = store.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, _GZIP)

    def add(self, data: bytes) -> None:
        self._out.write(self._engine.compress(data))
        self.count, self.size = self.count + 1, self.size + len(data)

    def close(self) -> None:
        self._out.write(self._engine.flush())
        self._out.close()


def _manifest(found: list[tuple[str, str | None, int]]) -> pa.RecordBatch:
    paths, indexes, counts = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(indexes, pa.string()), pa.array(counts, pa.int64())], ["path", "index", "records"])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic archives under ``folder``; returns the manifest.

    A payload is the html in UTF-8, empty when NULL. Of equal payloads of at least ``min_bytes`` the record with the
    largest page_id is the response and the others are revisits of it. A page without an id is always a response;
    repeated rows with the largest id are each one.
    """
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    # One row per payload, taken together before the shuffle; a payload of very many pages is a key that Spark splits.
    latest = whole.filter((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("latest"))
    judged = whole.join(latest, "digest", "left").select(
        "page_id", "url", "html",
        F.when((F.octet_length("html") >= min_bytes) & (F.col("page_id") < F.col("latest")), F.col("latest")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        done, out = [], None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = _Stream(store, f"{root}/pages-{uuid.uuid4().hex}.warc.gz")
                out.add(record(page_id, url, html.encode(), refers_to))
                if out.size >= archive_bytes:
                    out.close()
                    done.append((out.path, None, out.count))
                    out = None
        if out is not None:
            out.close()
            done.append((out.path, None, out.count))
        yield _manifest(done)

    return stage(judged.mapInArrow(run, _MANIFEST), "warc-written")


def _one_by_one(archives: DataFrame) -> DataFrame:
    """A partition per archive. The number is given, because by their few bytes the rows would all go to one task."""
    return archives.repartition(max(1, archives.count()))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite monolithic archives (a manifest with ``path``) under ``folder``, a gzip member per record, with an index.

    The sidecar index has a JSON line per record: offset and length of its member, record id and type. An archive is one
    task's work and streams through it. Returns the manifest of the new files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            for path in batch["path"].to_pylist():
                target = f"{root}/{path.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                count = at = 0
                with (store.open_input_stream(path, compression=None) as source,
                      store.open_output_stream(f"{target}.warc.gz", compression=None) as out,
                      store.open_output_stream(f"{target}.index", compression=None) as index):
                    for head, block in records(inflated(source, path)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                        member = engine.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + engine.flush()
                        fields = parsed(head)
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "id": fields.get("warc-record-id"),
                                                "type": fields.get("warc-type")}).encode() + b"\n")
                        at, count = at + len(member), count + 1
                yield _manifest([(f"{target}.warc.gz", f"{target}.index", count)])

    return stage(_one_by_one(archives.select("path")).mapInArrow(run, _MANIFEST), "warc-normalised")


_RECORDS = "page_id long, record_type string, refers_to long, url string, digest string, payload_bytes long, payload_digest string, payload binary"


def read_records(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record of normalised archives, each read by the offset and length in its index.

    ``digest`` is what the record states; ``payload_bytes`` and ``payload_digest`` are taken from the payload itself and
    NULL for revisits, which have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, index in zip(batch["path"].to_pylist(), batch["index"].to_pylist(), strict=True):
                with store.open_input_stream(index, compression=None) as source:
                    entries = [json.loads(line) for line in source.read().splitlines()]
                with store.open_input_file(path) as source:
                    for i in range(0, len(entries), 512):
                        found: list[list] = [[] for _ in range(8)]
                        for entry in entries[i:i + 512]:
                            source.seek(entry["offset"])
                            (head, block), = records(iter([zlib.decompress(source.read(entry["length"]), _GZIP)]))
                            fields = parsed(head)
                            response = fields["warc-type"] == "response"
                            payload = block.split(b"\r\n\r\n", 1)[1] if response else None
                            row = (_page_id(fields["warc-record-id"]), fields["warc-type"], _page_id(fields.get("warc-refers-to")),
                                   fields.get("warc-target-uri"), fields["warc-payload-digest"].removeprefix("sha1:"),
                                   len(payload) if response else None, base32_sha1(payload) if response else None,
                                   payload if with_payload else None)
                            for column, value in zip(found, row, strict=True):
                                column.append(value)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(found, kinds, strict=True)], [f.split()[0] for f in _RECORDS.split(", ")])

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return _one_by_one(archives.select("path", "index")).mapInArrow(run, _RECORDS)


def archived_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages``, normalise the archives and read them back, revisits resolved through the response they name.

    Per page: page_id, payload_bytes, payload_digest (upper-case base32 SHA-1), record_type, refers_to. A revisit whose
    response is missing or has another digest is an error. Other columns are ignored; repeated rows each come back.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    normal = normalise(write_archives(pages, f"{folder}/raw", min_bytes), f"{folder}/records")
    found = stage(read_records(normal, f"{folder}/records").drop("payload", "url"), "warc-records")
    responses = found.filter("record_type = 'response' AND page_id IS NOT NULL").groupBy(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    own = found.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    again = found.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(responses, ["refers_to", "digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", F.raise_error(F.lit("a revisit names a response that is not there")).cast("long")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(again)
