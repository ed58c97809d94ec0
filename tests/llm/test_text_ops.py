import hashlib
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.pretokens import ChunkTokenizer, ValueTable, chunk_block, chunks, text_blocks
from tessera.llm.queries import tokenizer
from tessera.llm.sentencepiece_codec import PieceModel, decode_pieces, encode_pieces, piece_digests, words
from tessera.llm.token_counts import bucketed, count_tokens, distinct_units, frequency_table, piece_lists, unpacked
from tessera.llm.url_filter import _absolute, _without_dots, canonical_form, filter_urls

ODD = ["one.\nTwo,\nthree \nfour\n five\n\nsix.\n", "a\nb c\nd", "", " ", "  ", "a  b", " lead", "trail ", "\n\n x", "tab\t\tx \n y", "don't 've 12,5", "<|endoftext|> a<|endoftext|>b <s> </s> <0x0A>", "é中文\U0001f600▁x▁▁", "a" * 300, "aa" * 50 + " " * 40, "\x00\x01\x1c \x1d a  b　 c", "!!! ??? ---- ====", "İstanbul ß"]


def fuzz(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    bits = ["the", " ", ",", ".\n", "word,", "  ", "\n", "ing", "é", "▁", "12", "7", "!", "'s", "中", "\U0001f600", "e", "E", "<|endoftext|>", "\t", "ab", "aba", "́"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_words_match_library():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    for text in ODD + fuzz(400, 1):
        parts = words(text)
        ids = [i for x in own.encode_words(parts) for i in x.tolist()]
        assert ids == lib.encode(text), repr(text)
        assert [i for x in own.encode_words(parts, single=True) for i in x.tolist()] == ids
        assert own.decode(ids) == lib.decode(ids)


def test_decode_any_ids_matches_library():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path), random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(0, 32000)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_chunks_keep_ids():
    from tokenizers import Tokenizer

    t, source = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), ChunkTokenizer(tokenizer("byte_bpe_50k.json"))
    for text in ODD + fuzz(400, 2):
        assert " ".join(chunks(text)) == text
        whole = t.encode(text, add_special_tokens=False).ids
        parts = [" " + c if k else c for k, c in enumerate(chunks(text))]
        assert np.frombuffer(b"".join(source.raw_ids(parts)), "<u4").tolist() == whole, repr(text)
    block = chunk_block([*ODD, *fuzz(50, 4)])
    texts = [*ODD, *fuzz(50, 4)]
    for k, doc in enumerate(block.order):
        assert "".join(block.distinct[i] for i in block.at[block.starts[k] : block.starts[k + 1]]) == texts[doc]


def test_value_table_keeps_values_right():
    def make(keys):
        return np.array([ord(c) for k in keys for c in k]), np.array([len(k) for k in keys], np.int64)

    table, rng = ValueTable(make, size=20), random.Random(9)
    for _ in range(300):
        keys = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 9))]
        starts, counts = table.find(keys)
        assert ["".join(map(chr, table.pool[a : a + n])) for a, n in zip(starts, counts, strict=True)] == keys
        assert len(table.counts) <= 30


def test_text_blocks():
    texts = ["a" * 5, None, "", "é" * 40, "b", "c", "", "d" * 3]
    for size in (1, 4, 10, 1000):
        made = [b.to_pylist() for b in text_blocks(pa.array(texts), size)]
        assert [t for b in made for t in b] == [t or "" for t in texts]
        assert all(len(b) == 1 or sum(len(t.encode()) for t in b) <= size for b in made)
    assert list(text_blocks(pa.array([], pa.string()), 5)) == []


PUNCTUATED = ["word$$$ a.%%%\nb,;!( c'd 'll they've 12,5 x-y (z) <|endoftext|> «ß» ¼ª²", "don't.\n'tis it's\n", "\u00adsoft a\u00a0b\u0085c", "[x] `y` {z}~ \\ a\\b ^_^ @home #1", "x\ny z\n"]


def test_punctuated_chunks_keep_ids():
    from tokenizers import Tokenizer

    t, source = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), ChunkTokenizer(tokenizer("byte_bpe_50k.json"))
    rng = random.Random(12)
    bits = ["ab", "Éa", "'", "'s", "'re", "$%", ".", "\n", "7", "½", "-", "<|endoftext|>", "ñ", " ", "x", "[", "\\", "`", "~", "中", "\xad", "\xa0", "²"]
    for text in [*PUNCTUATED, *["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(1500)]]:
        parts = [" " + c if k else c for k, c in enumerate(chunks(text))]
        assert source.ids(parts)[0].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_count_tokens(spark, name):
    import sentencepiece
    from tokenizers import Tokenizer

    path = tokenizer(name)
    texts = [*ODD, None, "word " * 5000, *ODD]
    size = (lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False))) if name.endswith("json") else (lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t)))
    rows = count_tokens(_docs(spark, texts), path).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows] == [(len((t or "").encode()), size(t or ""), size(t or "") > 1024) for t in texts]
    assert count_tokens(_docs(spark, texts).limit(0), path).count() == 0
    assert [tuple(r) for r in count_tokens(_docs(spark, [None, ""]), path, carry=[]).collect()] == [(0, 0, False)] * 2


def test_pre_tokens_are_counted_once_over_all_blocks(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    texts = [*ODD, None, *fuzz(60, 9)] * 2
    docs = spark.createDataFrame([(i, t, -i, "h", None) for i, t in enumerate(texts)], "doc_id long, text string, block long, head string, k long").repartition(6)
    table = frequency_table(docs, path, ["doc_id"])
    cells = bucketed(table, 4)
    units = {(r.bucket, r.block): unpacked(pa.array([r.lengths]), pa.array([bytes(r.units)])).to_pylist() for r in cells.collect()}
    owner = {}
    for (bucket, _), own in units.items():
        assert own and all(owner.setdefault(u, bucket) == bucket for u in own)
    assert table.count() > 3 and len(set(owner.values())) > 8
    listed = sorted((r.block, u) for r in table.collect() for u in distinct_units(r.n_units, pa.array([bytes(r.lengths)]), pa.array([bytes(r.distinct)]))[2])
    assert listed == sorted((block, u) for (_, block), own in units.items() for u in own) and len(listed) > len(owner)
    source = ChunkTokenizer(path)
    assert all(r.pieces == source.ids(units.pop((r.bucket, r.block)))[1].tolist() for r in piece_lists(cells, path).collect()) and not units
    lib = Tokenizer.from_file(path)
    rows = count_tokens(docs, path).collect()
    assert sorted((r.doc_id, r.text or "", r.block, r.head, r.k, r.n_tokens) for r in rows) == [(i, t or "", -i, "h", None, len(lib.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts)]


def test_piece_round_trip(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, None, *fuzz(40, 5)]
    docs = _docs(spark, texts)
    rows = piece_digests(docs, path).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        ids = lib.encode(t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    back = decode_pieces(encode_pieces(docs, path), path).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == [lib.decode(lib.encode(t or "")) for t in texts]
    assert piece_digests(docs.limit(0), path).count() == 0


def brute_dedup(texts):
    groups = {}
    for i, t in enumerate(texts):
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(key, []).append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup(spark, clash):
    from pyspark.sql import functions as F

    texts = ["A b", "a B", None, "", "É", "é", "x" * 200_000, "X" * 200_000, *["hot"] * 50, *map(str, range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("old")).repartition(7)
    # A digest that clashes: equal for all texts of a length.
    rows = exact_dedup(docs, digest=(lambda c: F.length(c).cast("string")) if clash else None).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == brute_dedup(texts)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_filter_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q=1", None),
        (2, "https://a.net/x", '<link rel="canonical" href="https://free.com/p">'),
        (3, "https://free.com/p", ""),
        (4, "https://other.com/q", '<meta http-equiv="refresh" content="0; url=https://free.com/p">'),
        (5, "https://example.com/de/1", None),
        (6, "https://alias.com/1", '<link href="https://www.example.com/de/1" rel=canonical>'),
        (7, "https://both.com/1", '<link rel="canonical" href="https://a.net/y">'),
        (8, "https://x.org/fr/z", '<link rel="canonical" href="https://both.com/1">'),
        (9, None, None),
        (10, "no scheme", "<p>"),
        (11, "https://evilnet/", None),
        (12, "https://example.com", None),
        (12, "https://example.com", None),
        (13, "ftp://net#x", None),
        (14, "http://net/?a=1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages).collect()}
    assert filter_urls(pages).count() == len(rows)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("a.net", "/x", "net/", "block")
    assert got[3] == ("free.com", "/p", None, "block") and got[4][3] == "block"
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == (None, "block")
    assert got[7][2:] == (None, "allow") and got[8][2:] == ("org/fr/", "allow")
    assert got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[11][2:] == (None, "allow") and got[12] == ("example.com", "", None, "allow")
    assert got[13] == ("net", "", None, "allow") and got[14][2:] == ("net/", "block")
    assert filter_urls(pages.limit(0).drop("html")).count() == 0
    redirects = spark.createDataFrame([("https://example.com", "https://b.net/")], "url string, target string")
    assert {r.verdict for r in filter_urls(pages, redirects).where("page_id = 12").collect()} == {"block"}


def _verdicts(spark, pages, redirects=None):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    given = spark.createDataFrame(redirects, "url string, target string") if redirects else None
    return [r.verdict for r in filter_urls(frame, given, rules=[("block", "bad.net", "/"), ("allow", "good.org", "/")]).orderBy("page_id").collect()]


def test_targets_in_variant_spellings(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        ("https://a.com/1", link.format("http://www.b.org/y?utm_source=1")),
        ("https://b.org/y", link.format("https://bad.net/")),
        ("https://a.com/2", link.format("https://b.org/x/../y/")),
        ("https://a.com/3", ""),
        ("https://a.com/4", link.format("http://m.b.org/y.html") + link.format("https://good.org/")),
    ]
    assert _verdicts(spark, pages[:3]) == ["block"] * 3
    assert _verdicts(spark, pages) == ["allow"] * 5
    assert _verdicts(spark, [*pages[:2], pages[3]], [("http://www.a.com/3/", "http://b.org/y#t")]) == ["block"] * 3
    assert _verdicts(spark, [*pages[:2], pages[3]], [("https://a.com/3", "/1")]) == ["block"] * 3


def test_relative_links(spark):
    page = "https://h.com/a/b/c?q=1"
    cases = {
        "page.html": "https://h.com/a/b/page.html",
        "../x": "https://h.com/a/x",
        "../../../x": "https://h.com/x",
        "..": "https://h.com/a/",
        "./": "https://h.com/a/b/",
        "?id=1": "https://h.com/a/b/c?id=1",
        "p?next=http://z.com/": "https://h.com/a/b/p?next=http://z.com/",
        "/r/./s": "https://h.com/r/s",
        "//o.com/t": "https://o.com/t",
        "http://o.com/u/../v?w=/../#f": "http://o.com/v?w=/../#f",
        "mailto:me": None,
        "#top": None,
    }
    frame = spark.createDataFrame([(page, k) for k in cases], "url string, link string")
    got = {r[0]: r[1] for r in frame.select("link", _without_dots(_absolute(frame.link, frame.url))).collect()}
    assert got == cases
    for base, want in [("https://h.com", "https://h.com/x"), ("h.com/a", None)]:
        frame = spark.createDataFrame([(base, "x")], "url string, link string")
        assert frame.select(_without_dots(_absolute(frame.link, frame.url))).first()[0] == want
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    for link, target in [("page.html", "https://h.com/a/b/page.html"), ("../x", "https://h.com/a/x"), ("?id=1", "https://h.com/a/b/c?id=1")]:
        pages = [(page, refresh.format(link)), (target, refresh.format("https://bad.net/"))]
        assert _verdicts(spark, pages) == ["block", "block"]


def test_all_links_of_a_page(spark):
    html = '<link rel="canonical" href="https://o.com/1"><link rel=canonical href=https://bad.net/2>'
    assert _verdicts(spark, [("https://a.com/", html)]) == ["block"]
    html = html.replace("<link rel", '<meta http-equiv="refresh" content="0; url=https://o.com/3"><link rel', 1) + "<meta http-equiv=refresh content='1; url=https://good.org/4'>"
    assert _verdicts(spark, [("https://a.com/", html)]) == ["allow"]


def test_canonical_form(spark):
    urls = ["http://www.a.com/x.html?utm_source=f&b=2#t", "https://m.a.com/x/?ref=1", "https://a.com/x?b=2", "none"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    got = [r[0] for r in df.orderBy("i").select(canonical_form(df.url)).collect()]
    assert got == ["https://a.com/x?b=2", "https://a.com/x", "https://a.com/x?b=2", None]


_WORKER = """
import pickle, random, re, sys
import pyarrow as pa
run = pickle.load(open(sys.argv[1], "rb"))
held = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
def task(seed, texts):
    rng = random.Random(seed)
    texts = [" ".join("%x" % rng.getrandbits(24) for _ in range(300)) for _ in range(texts)]
    assert sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))) == len(texts)
task(0, 10)
before = held()
for seed in range(1, 4):
    task(seed, 600)
print(held() - before)
"""


def test_piece_worker_gives_memory_back(spark, monkeypatch, tmp_path):
    """Between tasks a worker keeps little beside the model, however many words it has seen."""
    from pyspark import cloudpickle

    docs, caught = spark.createDataFrame([], "text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run))
    piece_digests(docs, tokenizer("piece_bpe_32k.model"), carry=[])
    (tmp_path / "run").write_bytes(cloudpickle.dumps(caught[0]))
    done = subprocess.run([sys.executable, "-c", _WORKER, str(tmp_path / "run")], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 80
