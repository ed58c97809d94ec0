import hashlib
import random

import pytest
from test_corpus_ops import brute_join, brute_mix
from test_text_ops import brute_dedup

import corpus_pipeline
from tessera.llm.mixing import WEIGHTS
from tessera.llm.quality import classify, train_on_labels
from tessera.llm.queries import tokenizer


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 7)))
    texts = []
    for i in range(240):
        bad = i % 5 == 0
        texts.append(" ".join(word() + ("!!" if bad else "") for _ in range(rng.randint(3, 300))))
    texts += [t.upper() for t in texts[1:9]] + [t + " end" for t in texts[11:19]] + [None, "", texts[3]]
    docs = [(i, t, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_matches_brute_force(spark, sf_dir):
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [tuple(r)[:4] for r in classify(docs, net).where("predicted = 1").orderBy("doc_id").collect()]
    assert 0.7 < len(kept) / docs.count() < 0.95
    ids = [r[0] for r in kept]
    dedup = brute_dedup([r[1] for r in kept])
    kept = [r for k, r in enumerate(kept) if dedup[k][2]]
    assert len(kept) < len(ids)
    groups = brute_join([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if groups[r[0]][0] == r[0]]
    copies = brute_mix(kept, 0.9, WEIGHTS, 1, 11, cuts := {})
    kept = [r for r in kept if copies[r[0]] or r[0] in cuts]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = {}
    for i, text, *_ in kept:
        pieces = lib.encode(text or "")
        want[i] = (len(pieces), hashlib.sha256(",".join(map(str, pieces)).encode()).hexdigest(), hashlib.sha256(lib.decode(pieces).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns, name
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_pipeline_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_on_repeated_and_missing_ids(spark, tmp_path):
    """Without labels nothing is rejected; each text is kept once, whatever its id is."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, three, long = text(60), text(60), text(60), text(20_000)
    docs = [(1, one), (1, two), (1, one), (2, one.upper()), (2, two + " end"), (None, three), (None, three + " end"), (None, one), (3, three + " more"), (4, None), (4, ""), (5, long), (6, long + " end")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        table = stage(spark, table, str(tmp_path))
        kept[name] = sorted(((r.doc_id, r.text) for r in table.collect()), key=str)
    assert len(kept["quality"]) == len(docs)
    want = [(2, one.upper()), (1, two), (2, two + " end"), (None, three), (None, three + " end"), (3, three + " more"), (4, None), (4, ""), (5, long), (6, long + " end")]
    assert kept["exact_dedup"] == sorted(want, key=str)
    gone = [(2, two + " end"), (None, three), (None, three + " end"), (6, long + " end")]
    assert kept["ngram_join"] == sorted([r for r in want if r not in gone], key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
