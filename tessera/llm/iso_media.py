"""Media columns in ISO base media containers.

A payload is stored losslessly as a raw 8-bit grey video track with 8 x 8 frames, so a
frame is 64 bytes: ftyp, moov (one track with its sample tables) and mdat. The reader
walks the nested boxes and decodes the sample tables of any such container (fixed or
listed sample sizes, 32- or 64-bit chunk offsets and box sizes); frames aren't decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FRAME = 64
#: Frames in a chunk; the first of each is marked as a keyframe.
CHUNK_FRAMES = 512
TIMESCALE, FRAME_TICKS = 25_000, 1_000
#: Boxes that only hold other boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """A container that holds ``payload``, whose size is a positive multiple of FRAME."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] if last == CHUNK_FRAMES else [(1, last, 1)] if chunks == 1 else [(1, CHUNK_FRAMES, 1), (chunks, last, 1)]
    duration = frames * FRAME_TICKS
    wide = len(payload) >= 1 << 31
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))

    def moov(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.int64) * (CHUNK_FRAMES * FRAME)
        place = _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME_TICKS)),
            _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * CHUNK_FRAMES + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            place,
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1)
        mdia = _box(b"mdia", mdhd, _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (16 if wide else 8)
    start = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join([ftyp, moov(head), start, payload])


def walk(data: memoryview, lo: int = 0, hi: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box types, begin, end of the content) of every box, parents first."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind, head = int.from_bytes(data[lo : lo + 4], "big"), bytes(data[lo + 4 : lo + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[lo + 8 : lo + 16], "big"), 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError("a box is larger than its parent")
        yield (*path, kind), lo + head, lo + size
        if kind in NESTED:
            yield from walk(data, lo + head, lo + size, (*path, kind))
        lo += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keyframes: np.ndarray


def tracks(media: bytes) -> list[Track]:
    """Sample tables of each track: where every sample lies, and which are keyframes."""
    data = memoryview(media)
    found: list[dict] = []
    for path, lo, hi in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif found and path[-1] in {b"mdhd", b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stco", b"co64"}:
            found[-1][path[-1]] = data[lo:hi]
    return [_track(x) for x in found if b"stsz" in x]


def _track(t: dict) -> Track:
    u4 = lambda kind, skip=8: np.frombuffer(t[kind][skip:], ">u4").astype(np.int64)
    one = lambda kind, at: int.from_bytes(t[kind][at : at + 4], "big")
    if t[b"mdhd"][0] == 1:
        timescale, duration = one(b"mdhd", 20), int.from_bytes(t[b"mdhd"][24:32], "big")
    else:
        timescale, duration = one(b"mdhd", 12), one(b"mdhd", 16)
    n = one(b"stsz", 8)
    sizes = np.full(n, one(b"stsz", 4), np.int64) if one(b"stsz", 4) else u4(b"stsz", 12)[:n]
    chunk = np.frombuffer(t[b"co64"][8:], ">u8").astype(np.int64) if b"co64" in t else u4(b"stco")
    runs = u4(b"stsc").reshape(-1, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunk) + 1]))
    if per_chunk.sum() != n:
        raise ValueError("the sample tables disagree")
    # A sample lies after those before it in its chunk.
    of = np.repeat(np.arange(len(chunk)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = chunk[of] + before - before[first[of]]
    keys = u4(b"stss") - 1 if b"stss" in t else np.arange(n)
    return Track(bytes(t[b"stsd"][12:16]).decode("latin-1"), timescale, duration, offsets, sizes, keys)


def read_samples(media: bytes, track: Track) -> bytes:
    """The stored bytes of all samples, in order; neighbours are copied together."""
    data, end = memoryview(media), track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != end[:-1]) + 1
    return b"".join(data[track.offsets[a] : end[b - 1]] for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(end)], strict=True))


def keyframe_ranges(track: Track) -> list[tuple[int, int]]:
    """(begin, end) of each keyframe's bytes in the container."""
    at = track.offsets[track.keyframes]
    return list(zip(at.tolist(), (at + track.sizes[track.keyframes]).tolist(), strict=True))


def feature(track: Track) -> str:
    """Codec, duration in ticks and keyframe byte ranges, as one string."""
    ranges = ",".join(f"{a}-{b}" for a, b in keyframe_ranges(track))
    return f"codec={track.codec.strip()};duration={track.duration}/{track.timescale};keyframes={ranges}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, UTF-8 with bytes 0 up to a positive multiple of FRAME)."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % FRAME or (0 if raw else FRAME))


def _mapped(df: DataFrame, fields: T.StructType, keep: list[str], source: str, step) -> DataFrame:
    names = fields.names
    keep = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A few rows at a time, so that long documents never pile up.
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                values = [step(x) for x in batch.column(source).to_pylist()]
                columns = [pa.array([v[i] for v in values], type=pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *names])

    return df.select(*dict.fromkeys([*keep, source])).mapInArrow(run, T.StructType([*df.select(*keep).schema.fields, *fields.fields]))


def store_media(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) plus ``n_bytes`` and the container ``media``.

    Null and empty texts store one frame of zeros; a text of any length is stored whole.
    Repeated rows each get a row, an empty table gives none. Input columns of these names
    are replaced.
    """

    def step(text: str | None) -> tuple:
        n, payload = payload_of(text)
        return n, mux(payload)

    fields = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return _mapped(docs, fields, docs.columns if carry is None else carry, text_col, step)


def media_features(stored: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Read containers: ``payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    ``tail_crc32`` is over the payload's last 64 bytes. Null media give nulls.
    """

    def step(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        track = tracks(media)[0]
        payload = read_samples(media, track)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)

    kinds = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    fields = T.StructType([T.StructField(k, t) for k, t in kinds.items()])
    return _mapped(stored, fields, [c for c in stored.columns if c != "media"] if carry is None else carry, "media", step)
