"""WARC archives: one gzip member per record, written by tasks and read sequentially.

The reader inflates incrementally, so it holds one record's bytes at most; a record is
framed by its Content-Length, a member must end where its record does, and block and
payload digests are verified. Records whose payload another response holds are revisits
with headers only; what they say of the payload is held against that response. A manifest lists the archives of tasks that ended; files of lost or
repeated tasks aren't in it and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, shared_dir
from .skew import attach

#: Payloads shorter than this are always stored.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"
MANIFEST = "part int, path string, records bigint, bytes bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"


def _clean(url: str | None) -> str:
    """A header value: line ends and other controls are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The response of a page, or its revisit if ``refers_to`` names the page with the payload."""
    block = _HTTP + payload if refers_to is None else _HTTP
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _clean(url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", _label(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", _label(hashlib.sha1(block).digest())),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", _PROFILE)]
    return member(headers, block)


def members(stream) -> Iterator[bytes]:
    """Each gzip member of a stream, inflated piece by piece."""
    held = b""
    while True:
        held = held or stream.read(READ_BYTES)
        if not held:
            return
        z = zlib.decompressobj(31)
        parts = []
        while not z.eof:
            held = held or stream.read(READ_BYTES)
            if not held:
                raise ValueError("the archive ends inside a record")
            parts.append(z.decompress(held))
            held = z.unused_data if z.eof else b""
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; framing and digests must hold."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not mark or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the record")
    block = rest[:size]
    if headers.get("warc-block-digest") != _label(hashlib.sha1(block).digest()):
        raise ValueError("block digest mismatch")
    return headers, block


def read_page(headers: dict[str, str], block: bytes) -> tuple:
    """The RECORD row of a response or revisit, with its payload's digest verified."""
    kind, digest = headers["warc-type"], headers["warc-payload-digest"]
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response" and digest != _label(hashlib.sha1(payload).digest()):
        raise ValueError("payload digest mismatch")
    number = lambda urn: int(urn.rpartition(":")[2].rstrip(">")) if urn.startswith("<urn:page:") else None
    size = len(payload) if kind == "response" else int(headers["x-payload-length"])
    refers = headers.get("warc-refers-to")
    return number(headers["warc-record-id"]), headers["warc-target-uri"], size, base64.b32decode(digest.removeprefix("sha1:")).hex(), kind, number(refers) if refers else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to``: the page that holds an equal payload, or null.

    Payloads count as equal by SHA-256. Of equal ones of REVISIT_BYTES or more, that with
    the largest page_id is stored. Rows that repeat this page_id are all stored, and so are
    rows without a page_id if no equal payload has one. Null html is an empty payload.
    Extra columns are ignored, whatever their names; an empty table gives none.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.sha2(payload, 256)
    large = pages.select("page_id", F.octet_length(payload).alias("n"), digest.alias("digest")).where(F.col("n") >= REVISIT_BYTES)
    groups = materialise(large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    rows = pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest"))
    found = attach(rows, groups, "digest", "size", pages.count())
    return found.select("page_id", "url", "payload", F.when(~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page; returns the manifest ``part, path, records, bytes``.

    Null html is an empty payload, a null url an empty target; the record of a null page_id
    has no number. Payloads of any length are one record. Tasks start a new archive after
    ARCHIVE_BYTES; an empty table has none.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        out = path = None
        records = size = 0

        def end() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([records]), pa.array([size])], names=["part", "path", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    path, records, size = f"{base}/warc/part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(f"{base}/warc", recursive=True)
                    out = store.open_output_stream(path)
                    fields = b"format: WARC File Format 1.1\r\n"
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", _label(hashlib.sha1(fields).digest()))], fields)
                    out.write(info)
                record = page_record(page_id, url, payload, refers_to)
                out.write(record)
                records, size = records + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    yield end()
                    out = None
        if out is not None:
            yield end()

    return materialise(with_revisits(pages).mapInArrow(write, MANIFEST), f"{folder}/manifest")


def check_revisits(rows: DataFrame) -> None:
    """Fail unless each revisit names a response with its payload's digest and size."""
    told = [F.col(c) for c in ("payload_digest", "payload_bytes")]
    # One row per claim, so no payload's revisits meet in one task.
    claims = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("holder"), *told).distinct()
    held = rows.where("record_type = 'response'").select(F.col("page_id").alias("holder"), *told)
    wrong = claims.join(held, ["holder", "payload_digest", "payload_bytes"], "left_anti").first()
    if wrong is not None:
        raise ValueError(f"no response of page {wrong.holder} has the payload that a revisit names: {wrong.payload_digest}, {wrong.payload_bytes} bytes")


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The RECORD rows of all pages in the archives, revisits checked; a task reads one archive at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def rows(path: str) -> Iterator[tuple]:
            with store.open_input_stream(path) as stream:
                for raw in members(stream):
                    headers, block = parse(raw)
                    if headers["warc-type"] in ("response", "revisit"):
                        yield read_page(headers, block)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                held: list[tuple] = []
                for row in rows(path):
                    held.append(row)
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    found = materialise(manifest.select("path").repartition(max(manifest.count(), 1)).mapInArrow(read, RECORD))
    check_revisits(found)
    return found


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) and read them back as RECORD rows.

    One row per page: see :func:`with_revisits` and :func:`write_archives` for nulls,
    repeated rows and ties.
    """
    folder = shared_dir(pages.sparkSession)
    return read_archives(pages.sparkSession, write_archives(pages, folder), folder)
