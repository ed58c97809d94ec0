"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies.

1. Blocks of documents are cut where no piece crosses and written, a row each: the block's
   distinct pre-tokens in the order of their hashes and, per document, which of them it has
   and how often.
2. Blocks send their pre-tokens to buckets by ranges of hashes. A bucket counts each of its
   distinct pre-tokens once, so each is counted once in the whole run, and sends the counts
   back. A block lists a pre-token once, so none is in more rows than there are blocks.
3. A block's counts, in the order of buckets, are those of its pre-tokens in order. They are
   multiplied with its frequencies and summed by document.

Ids of a document never exist. What is shuffled grows with the distinct pre-tokens of
blocks, not with the pre-tokens or (document, pre-token) pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import Chunked, ChunkTokenizer, chunk_block, strings, text_blocks
from .sentencepiece_codec import PieceModel, word_block
from .shared import materialise

#: Bytes of text in a block: the larger, the fewer pre-tokens are in several; it bounds a worker's memory whatever the batch.
BLOCK_BYTES = 16_000_000
#: Pre-tokens of blocks in a bucket, from half as many to about as many.
BUCKET_UNITS = 500_000


class JsonCounter:
    """Pieces of chunks by a tokenizers file."""

    def __init__(self, path: str) -> None:
        self.source = ChunkTokenizer(path)

    def pieces(self, keys: list[str]) -> np.ndarray:
        return self.source.ids(keys)[1]


class PieceCounter:
    """Pieces of words by a sentencepiece file."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)

    def pieces(self, keys: list[str]) -> np.ndarray:
        return self.model.encode_flat(keys)[1]


@functools.lru_cache(maxsize=1)
def counter(path: str) -> JsonCounter | PieceCounter:
    """A file's counter; a worker keeps it from task to task."""
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def _pack(values: np.ndarray) -> pa.Array:
    """One compressed value: all low bytes, then all second bytes and so on, as the high ones are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.array([pa.compress(planes.tobytes(), "zstd", asbytes=True)], pa.binary())


def _unpack(packed: pa.Array, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed[0].as_py(), 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def frequencies(block: Chunked, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pre-tokens that each document has, which these are, how often each), by document and place in ``block.distinct``."""
    width = max(len(block.distinct), 1)
    pair, times = np.unique(np.repeat(block.order, np.diff(block.starts)) * width + block.at, return_counts=True)
    doc, unit = np.divmod(pair, width)
    return np.bincount(doc, minlength=n_docs), unit, times


def _single(values: pa.Array) -> pa.Array:
    """One list of all ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def hashes(units: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(units, dtype=object), categorize=False) if units else np.zeros(0, np.uint64)


def frequency_table(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """A row per block: ``block``, its documents (``keep`` and ``n_bytes``), their frequencies and the distinct pre-tokens, packed."""
    fields = [T.StructField(f.name, f.dataType) for f in docs.select(*keep).schema] + [T.StructField("n_bytes", T.LongType())]
    packed = [T.StructField(c, T.BinaryType()) for c in ("sizes", "units", "times")]
    schema = T.StructType([T.StructField("docs", T.ArrayType(T.StructType(fields))), *packed, T.StructField("n_units", T.LongType()), T.StructField("lengths", T.BinaryType()), T.StructField("distinct", T.BinaryType())])
    cut = word_block if path.endswith(".model") else chunk_block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_blocks(batch.column(text_col), BLOCK_BYTES):
                block = cut(texts)
                order = np.argsort(hashes(block.distinct), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                sizes, units, times = frequencies(Chunked(block.distinct, rank[block.at], block.starts, block.order), len(texts))
                own = pa.StructArray.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in keep), pc.binary_length(texts)], names=[*keep, "n_bytes"])
                distinct = [block.distinct[k] for k in order.tolist()]
                lengths = np.fromiter((len(u.encode()) for u in distinct), np.int64, len(distinct))
                raw = pa.array([pa.compress("".join(distinct).encode(), "zstd", asbytes=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([_single(own), _pack(sizes), _pack(np.diff(units, prepend=0)), _pack(times), pa.array([len(distinct)]), _pack(lengths), raw], names=schema.names)
                at += len(texts)

    made = docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)
    return materialise(made.withColumn("block", F.monotonically_increasing_id()))


def distinct_units(n: int, lengths: pa.Array, distinct: pa.Array) -> tuple[np.ndarray, pa.Buffer, list[str]]:
    """(ends of the pre-tokens in their bytes, the bytes, the pre-tokens) of one row of :func:`frequency_table`."""
    ends = np.r_[0, np.cumsum(_unpack(lengths, n), dtype=np.int64)]
    raw = pa.decompress(distinct[0].as_py(), int(ends[-1]), "zstd")
    return ends, raw, strings(pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), raw))


def bucketed(table: DataFrame, bits: int) -> DataFrame:
    """``bucket, block, lengths, units``: a block's pre-tokens by the first ``bits`` bits of their hashes, with their bytes one after the other.

    Buckets without any have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (block, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if not n:
                    continue
                ends, raw, units = distinct_units(n, batch.column(2).slice(at, 1), batch.column(3).slice(at, 1))
                buckets, first = np.unique(hashes(units) >> np.uint64(64 - bits), return_index=True)
                cuts = np.r_[first, n]
                lengths = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.diff(ends), pa.int32()))
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(buckets), [None, pa.py_buffer(ends[cuts].tobytes()), raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array(np.full(len(buckets), block)), lengths, cells], names=["bucket", "block", "lengths", "units"])

    return table.select("block", "n_units", "lengths", "distinct").mapInArrow(run, "bucket bigint, block bigint, lengths array<int>, units binary")


def unpacked(lengths: pa.Array, units: pa.Array) -> pa.Array:
    """The pre-tokens of all rows of ``lengths, units``."""
    each = lengths.flatten().to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(each, dtype=np.int64)]
    return pa.LargeStringArray.from_buffers(len(each), pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(units.to_pylist())))


def piece_lists(cells: DataFrame, path: str) -> DataFrame:
    """``bucket, block, pieces``: for each row of :func:`bucketed` how many pieces its units have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            units = unpacked(rows.column("lengths"), rows.column("units")).dictionary_encode()
            pieces = counter(path).pieces(strings(units.dictionary))[units.indices.to_numpy()]
            offsets = np.r_[0, np.cumsum(pc.list_value_length(rows.column("lengths")).to_numpy())]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pieces, pa.int32()))
            return pa.RecordBatch.from_arrays([rows.column("bucket"), rows.column("block"), lists], names=["bucket", "block", "pieces"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b > a and held[0].column("bucket")[0].as_py() != bucket[a]:
                    yield counted(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield counted(held)

    return cells.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket bigint, block bigint, pieces array<int>")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) plus ``n_bytes, n_tokens, over_limit`` (``n_tokens > limit``).

    Counts are those of the library for the file (.json: tokenizers, .model:
    sentencepiece) over the whole text, with no begin, end or added tokens, truncation or
    padding; special strings in a text count as the library has it. A null text counts as
    empty: 0 bytes, 0 tokens; a text of any length is counted whole. Repeated rows each get
    a row, an empty table gives none; input columns with the name of a result column are
    replaced.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in (docs.columns if carry is None else carry) if c not in names]
    table = frequency_table(docs, path, keep, text_col)
    entries = table.agg(F.sum("n_units")).first()[0] or 0
    found = piece_lists(bucketed(table, max(1, (entries // BUCKET_UNITS).bit_length())), path)
    heads = table.select("block", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("array<int>").alias("pieces"), F.struct("docs", "sizes", "units", "times").alias("head"))
    none = F.lit(None).cast(heads.schema["head"].dataType).alias("head")
    # A block's head, then the pieces of its pre-tokens in the order that the head numbers them by.
    rows = found.select("block", "bucket", "pieces", none).unionByName(heads).repartition("block").sortWithinPartitions("block", "bucket")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def sums(head: pa.StructArray, pieces: np.ndarray) -> pa.RecordBatch:
        own, *packed = head.flatten()
        own = own.flatten()
        sizes = _unpack(packed[0], len(own))
        units, times = (_unpack(p, int(sizes.sum())).astype(np.int64) for p in packed[1:])
        n_tokens = np.bincount(np.repeat(np.arange(len(own)), sizes), weights=times * pieces[np.cumsum(units)], minlength=len(own)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*own.flatten(), pa.array(n_tokens)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for batch in batches:
            lists, start = batch.column("pieces"), 0
            pieces = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
            for at in [*np.flatnonzero(batch.column("bucket").to_numpy() < 0).tolist(), batch.num_rows]:
                parts.append(pieces[ends[start] : ends[at]])
                if at < batch.num_rows:
                    if head is not None:
                        yield sums(head, np.concatenate(parts))
                    head, parts = batch.column("head").slice(at, 1), []
                start = at + 1
        if head is not None:
            yield sums(head, np.concatenate(parts))

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
