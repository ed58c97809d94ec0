import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import iso_media, quality, simple8b, warc
from tessera.llm.queries import tokenizer
from tessera.llm.token_files import pack_segment, read_segments, token_file_digests

TEXTS = ["", None, " ", "one", "two words", "é中文\U0001f600 x" * 50, "a b " * 9000, "dup " * 400, "dup " * 400, "<|endoftext|> x"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    coded = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(coded).tolist() == values
    for k in range(len(coded.offsets) - 1):
        assert simple8b.decode_block(coded, k).tolist() == values[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]


def test_simple8b_edges():
    for values in ([], [0] * 5000, [2**60 - 1, 2**60, 2**53 + 1] * 400, [1] * 1024, list(range(1025))):
        assert simple8b.decode(simple8b.encode(np.array(values, np.uint64))).tolist() == values
    assert len(simple8b.encode(np.zeros(1024, np.uint64)).words) == 5
    assert len(simple8b.encode(np.full(1020, 1000, np.uint64)).words) == 170


def test_segments():
    raw = pack_segment([None, 5], np.array([0, 3]), np.array([1, 2, 70000])) + pack_segment([9], np.array([1]), np.array([7]))
    got = [(d, s.tolist(), i.tolist()) for d, s, i in read_segments(io.BytesIO(raw))]
    assert got == [([None, 5], [0, 3], [1, 2, 70000]), ([9], [1], [7])]
    with pytest.raises(ValueError):
        list(read_segments(io.BytesIO(raw[:-1])))


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = list(range(len(TEXTS)))
    random.Random(1).shuffle(ids)
    docs = spark.createDataFrame([(i, TEXTS[i], "y") for i in ids], "doc_id long, text string, start string").repartition(3)
    rows = token_file_digests(docs, path).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(rows, TEXTS, strict=True):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert token_file_digests(docs.limit(0), path).count() == 0


def test_media_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, "z" * 64 * 513, "q" * 64 * 1024])), "doc_id long, text string")
    rows = iso_media.media_features(iso_media.store_media(docs)).orderBy("doc_id").collect()
    for r in rows:
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        media = iso_media.mux(padded)
        assert (r.payload_sha256, r.media_bytes, r.media_sha256) == (hashlib.sha256(padded).hexdigest(), len(media), hashlib.sha256(media).hexdigest())
    assert iso_media.media_features(iso_media.store_media(docs.limit(0))).count() == 0


def test_media_boxes():
    payload = bytes(range(256)) * 256
    media = iso_media.mux(payload)
    kinds = [b"/".join(p) for p, _, _ in iso_media.walk(memoryview(media))]
    assert kinds[0] == b"ftyp" and kinds[-1] == b"mdat" and b"moov/trak/mdia/minf/stbl/stco" in kinds
    (track,) = iso_media.tracks(media)
    assert iso_media.read_samples(media, track) == payload
    assert [media[a:b] for a, b in iso_media.keyframe_ranges(track)] == [payload[k * 64 : k * 64 + 64] for k in (0, 512)]
    assert iso_media.feature(track).startswith("codec=raw;duration=1024000/25000;keyframes=")
    with pytest.raises(ValueError):
        list(iso_media.walk(memoryview(media[:-1])))


def test_warc(spark):
    big, same = "é" * 600, "s" * 999
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", same), (5, "u", same), (6, "v", None), (7, "w", "\r\n\r\nWARC/1.1"), (8, "x", big + "!")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = {r.page_id: r for r in warc.warc_round_trip(df).collect()}
    assert len(rows) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (rows[i].record_type, rows[i].refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))
    assert rows[2].url == "http://b/%0D%0AX: y"
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_detects_damage():
    good = warc.page_record(1, "u", b"payload", None)
    assert warc.read_page(*warc.parse(b"".join(warc.members(io.BytesIO(good)))))[2] == 7
    record = b"".join(warc.members(io.BytesIO(good)))
    for bad in (record.replace(b"payload", b"Payload"), record[:-1], record.replace(b"Content-Length: 6", b"Content-Length: 7")):
        with pytest.raises(ValueError):
            warc.read_page(*warc.parse(bad))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(good[:-4])))


@pytest.mark.parametrize("revisit", [(b"payload", 1), (b"Payload", 1), (b"payloads", 1), (b"payload", 3), (b"payload", 2)])
def test_warc_checks_revisits(spark, tmp_path, revisit):
    """Only a revisit of the payload that the named response has is read."""
    path = tmp_path / "a.warc"
    path.write_bytes(warc.page_record(1, "u", b"payload", None) + warc.page_record(2, "u", *revisit))
    manifest = spark.createDataFrame([(0, str(path), 2, path.stat().st_size)], warc.MANIFEST)
    if revisit == (b"payload", 1):
        assert {r.page_id: r.refers_to for r in warc.read_archives(spark, manifest, tmp_path.as_uri()).collect()} == {1: None, 2: 1}
    else:
        with pytest.raises(ValueError):
            warc.read_archives(spark, manifest, tmp_path.as_uri()).collect()


def test_warc_needs_block_digests():
    record = b"".join(warc.members(io.BytesIO(warc.page_record(1, "u", b"payload", None))))
    line = next(x for x in record.split(b"\r\n") if x.startswith(b"WARC-Block-Digest"))
    with pytest.raises(ValueError):
        warc.parse(record.replace(line + b"\r\n", b""))


def test_chunks_cover_the_text():
    for n in (0, 1, 1023, 1024, 1025, 1920, 5000):
        rng = random.Random(n)
        text = "".join(rng.choice("abcdefgh") for _ in range(n))
        chunks, lengths = quality.cut(text)
        seen = set()
        for c, m in zip(chunks, lengths, strict=True):
            at = text.encode().find(bytes(c[:m]))
            seen.update(range(at, at + m))
        assert len(seen) == n


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = quality.Net.start(1)
    for k, p in enumerate(net.parameters()):
        setattr(net, ["embedding", "filters", "bias", "mean_weight", "max_weight", "offset"][k], p.astype(np.float64))
    chunks, lengths = rng.integers(0, 255, (5, quality.CHUNK)).astype(np.uint8), np.array([1024, 1024, 100, 3, 1024])
    starts, labels = np.array([0, 2, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(labels * np.log(p := quality._combine(net, quality._pool(net, chunks, lengths), starts)[0]) + (1 - labels) * np.log(1 - p))
    for p, g in zip(net.parameters(), quality._gradients(net, chunks, lengths, starts, labels), strict=True):
        for at in rng.permutation(p.size)[:6]:
            i = np.unravel_index(at, p.shape)
            was = p[i]
            p[i] = was + 1e-5
            up = loss()
            p[i] = was - 1e-5
            slope = (up - loss()) / 2e-5
            p[i] = was
            assert abs(slope - g[i]) < 1e-4 + 0.02 * abs(slope)


def test_classifier_learns(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() + ("!!" if i % 3 == 0 else "") for _ in range(rng.randint(3, 400))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(900, None, "z"), (901, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    net = quality.train_on_labels(docs, labels, rows=250)
    rows = quality.classify(docs, net).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in rows if r.doc_id < 400]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 402
    assert quality.train_on_labels(docs, labels.limit(0)) is None
    assert quality.classify(docs.limit(0), net).count() == 0
    assert {r.score for r in quality.classify(docs, None).collect()} == {0.5}
