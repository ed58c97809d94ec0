"""Token-ID files: documents in ascending id order, ids coded in 64-bit words.

A file is a run of segments, each of about SEGMENT_IDS ids and readable alone:

    magic ``TSR8B001``; documents, ids, words, blocks, escapes (five uint64)
    document ids (int64), validity (uint8), ids per document (uint64)
    word offsets of the blocks and their end (uint64), words (uint64)
    places and values of escapes (uint64 each)

All integers are little-endian. A manifest table lists the files in document order. Only
files of tasks that ended are in it, so what a lost or repeated task left is never read.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretokens import ChunkTokenizer, ValueTable, chunk_block, gather, sums, text_blocks
from .shared import materialise, shared_dir
from .simple8b import Coded, decode, encode

MAGIC = b"TSR8B001"
SEGMENT_IDS = 400_000
#: Bytes of text encoded at a time.
BLOCK_BYTES = 4_000_000
MANIFEST = "part int, path string, n_docs bigint, n_ids bigint"


def _array(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def pack_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    coded = encode(ids)
    valid = np.fromiter((i is not None for i in doc_ids), np.uint8, len(doc_ids))
    known = np.fromiter((0 if i is None else i for i in doc_ids), np.int64, len(doc_ids))
    head = MAGIC + struct.pack("<5Q", len(doc_ids), coded.size, len(coded.words), len(coded.offsets) - 1, len(coded.escape_at))
    return b"".join([head, _array(known, "<i8"), _array(valid, "u1"), _array(sizes, "<u8"), _array(coded.offsets, "<u8"), _array(coded.words, "<u8"), _array(coded.escape_at, "<u8"), _array(coded.escape_value, "<u8")])


def read_segments(stream) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, ids per document, ids) of each segment of an open file."""

    def exactly(n: int) -> bytes:
        parts, left = [], n
        while left:
            part = stream.read(left)
            if not part:
                raise ValueError("the file ends inside a segment")
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    def array(kind: str, n: int) -> np.ndarray:
        return np.frombuffer(exactly(n * np.dtype(kind).itemsize), kind)

    while head := stream.read(8):
        while len(head) < 8 and (more := stream.read(8 - len(head))):
            head += more
        if head != MAGIC:
            raise ValueError("not a token file")
        n_docs, size, n_words, n_blocks, n_escapes = struct.unpack("<5Q", exactly(40))
        known, valid, sizes = array("<i8", n_docs), array("u1", n_docs), array("<u8", n_docs).astype(np.int64)
        offsets, words = array("<u8", n_blocks + 1).astype(np.int64), array("<u8", n_words)
        at, value = array("<u8", n_escapes).astype(np.int64), array("<u8", n_escapes)
        yield [int(i) if ok else None for i, ok in zip(known, valid, strict=True)], sizes, decode(Coded(size, words, offsets, at, value))


class IdEncoder:
    """Ids of whole texts by the tokenizers library, through a table of chunks."""

    def __init__(self, path: str) -> None:
        self.table = ValueTable(ChunkTokenizer(path).ids)

    def encode(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text): each text's ids and then ``end``."""
        block = chunk_block(texts).in_order()
        first, sizes = self.table.find(block.distinct)
        # One more chunk for the end of a text, then chunks become ids by gathering ranges.
        first, sizes = np.r_[first, len(self.table.pool)], np.r_[sizes, len(end)]
        pool = np.concatenate([self.table.pool, end.astype(np.int32)])
        at = np.insert(block.at, block.starts[1:], len(block.distinct))
        counts = sums(sizes[at], block.starts + np.arange(len(block.starts)))
        return gather(pool, first[at], sizes[at]).astype("<u4"), counts


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> IdEncoder:
    """A worker keeps its encoder, with its table, from task to task."""
    return IdEncoder(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files; returns the manifest ``part, path, n_docs, n_ids``, ordered by part.

    Ids are integers. Documents are in ascending order of ``id_col``, null ids first; the
    order among rows with the same id is open. A null or empty text has no ids but the end
    id; a text of any length is encoded whole. An empty table has no files; extra columns
    are ignored.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        path, out, n_docs, n_ids = f"{base}/ids/part-{part:06d}-{uuid.uuid4().hex}.tsr", None, 0, 0
        encoder, end = encoder_of(tokenizer_path), np.array([] if end_id is None else [end_id], "<u4")
        doc_ids: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            out.write(pack_segment(doc_ids, np.concatenate(counts), np.concatenate(ids)))
            doc_ids.clear()
            counts.clear()
            ids.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(f"{base}/ids", recursive=True)
                out = store.open_output_stream(path)
            at = 0
            for texts in text_blocks(batch.column(1), BLOCK_BYTES):
                made, sizes = encoder.encode(texts, end)
                doc_ids += batch.column(0)[at : at + len(texts)].to_pylist()
                at += len(texts)
                counts.append(sizes)
                ids.append(made)
                held += len(made)
                if held >= SEGMENT_IDS:
                    n_docs, n_ids, held = n_docs + len(doc_ids), n_ids + held, 0
                    flush()
        if out is not None:
            n_docs, n_ids = n_docs + len(doc_ids), n_ids + held
            if doc_ids:
                flush()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs]), pa.array([n_ids])], names=["part", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    return materialise(ordered.mapInArrow(write, MANIFEST), f"{folder}/manifest").orderBy("part")


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, run, fields: str) -> DataFrame:
    """Apply ``run(start, doc_ids, sizes, ids)`` to each segment; it returns a record batch.

    ``start`` counts the ids of all documents before the segment. One task reads one file.
    """
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(path) as stream:
                    for doc_ids, sizes, ids in read_segments(stream):
                        yield run(start, doc_ids, sizes, ids)
                        start += len(ids)

    return files.select("path", "start").repartition(max(manifest.count(), 1)).mapInArrow(read, fields)


def _digest(start: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write token files and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before, ``n_tokens`` has the end id, and
    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers. One row per
    input row; an empty table gives none.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    manifest = write_token_files(docs, tokenizer_path, end_id, folder=folder)
    return read_token_files(spark, manifest, folder, _digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
