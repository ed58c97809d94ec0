import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join
from tessera.llm.components import components
from tessera.llm.mixing import mix, word_count
from tessera.llm.ngram_join import jaccard_matrix, ngram_jaccard_join, prefix_depth


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute_join(docs, threshold=0.8):
    sets = {i: shingles(t) for i, t in docs}
    links = {i: 0 for i, _ in docs}
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(i), links[i]) for i in ids}


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5)))
    shared = [word() for _ in range(60)]
    texts = []
    while len(texts) < size:
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 12, 40, 120, 400]))]
        if rng.random() < 0.4:
            base = shared + base
        for _ in range(rng.choice([1, 1, 1, 2, 4, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if rng.random() < 0.9 else "  ".join(copy).upper())
    return texts[:size]


def test_prefix_depth():
    depth = prefix_depth(0.8, 32, 8, 0.9994)
    assert 1 - (1 - 0.8**depth) ** 32 >= 0.9994 > 1 - (1 - 0.8 ** (depth + 1)) ** 32
    assert prefix_depth(0.1, 4, 8, 0.99) == 1


def test_jaccard_matrix_is_exact():
    texts = [*corpus(1, 60), "", None, "a b c d e", "a b c d", "a b c"]
    total, sizes = jaccard_matrix(texts, 5)
    sets = [shingles(t) if (t or "").split() else set() for t in texts]
    assert sizes.tolist() == [len(s) for s in sets]
    for i, a in enumerate(sets):
        assert [int(x) for k, x in enumerate(total[i]) if k != i] == [len(a & b) for k, b in enumerate(sets) if k != i]
    assert (jaccard_matrix(texts, 5, 20)[0] == total[:20, 20:]).all()


@pytest.mark.parametrize("block", [384, 7])
def test_ngram_join_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = [*corpus(2, 500), None, "", "   ", "x " * 30000, "x " * 30001]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect()}
    want = brute_join(list(enumerate(texts)))
    missed = [i for i in want if got[i] != want[i]]
    assert not missed, [(i, got[i], want[i]) for i in missed[:5]]
    assert ngram_jaccard_join(docs.limit(0)).count() == 0


def test_crowded_prefix_keeps_its_pairs(spark, monkeypatch):
    """The smallest member of a prefix is unlike all others, which are pairs of like sketches."""
    rng = random.Random(5)
    word = lambda: rng.getrandbits(64) - 2**63
    pairs = [[word() for _ in range(4)] for _ in range(40)]
    rows = [(0, 1, [7], *(word() for _ in range(4)), 64)] + [(1 + k + 40 * half, 1, [7], *pairs[k], 64) for k in range(40) for half in range(2)]
    reps = spark.createDataFrame(rows, "id long, copies long, prefixes array<long>, sketch0 long, sketch1 long, sketch2 long, sketch3 long, allowed long")
    nodes = reps.selectExpr("prefixes[0] as node", "id")
    for block in (2048, 9):
        monkeypatch.setattr(ngram_join, "PREFIX_BLOCK", block, raising=False)
        got = {(r.node, r.component) for r in components(ngram_join._candidates(reps, nodes), "a", "b").collect()}
        assert got == {(1 + k + 40 * half, 1 + k) for k in range(40) for half in range(2)}


def test_few_shingles_are_not_cut():
    """Pairs at 0.8 with few shingles differ in more bits than long ones do."""
    rng = random.Random(6)
    cut = 0
    for _ in range(3000):
        words = [str(rng.random()) for _ in range(13)]
        made = ngram_join.forest_rows([" ".join(words), " ".join([*words[:-1], "x"])], 5, 7)
        a, b = ([made.column(f"sketch{k}").to_pylist()[i] for k in range(4)] for i in range(2))
        differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
        cut += differ > max(made.column("allowed").to_pylist() if "allowed" in made.schema.names else [64])
    assert cut == 0


def test_ngram_join_under_a_template(spark, monkeypatch):
    """Thousands of documents share 35 % of their shingles, and pairs of them are at 0.8."""
    monkeypatch.setattr(ngram_join, "PREFIX_BLOCK", 16, raising=False)
    rng = random.Random(7)
    word = lambda: str(rng.getrandbits(40))
    template = [word() for _ in range(110)]
    texts, pairs = [template + [word() for _ in range(98)] for _ in range(2500)], {}
    for k in range(300):
        own = [word() for _ in range(98)]
        # 204 shingles each, 182 in common: 182 / 226 is just over 0.8.
        pairs[len(texts)] = len(texts) + 1
        texts += [template + own, template + own[:-22] + [word() for _ in range(22)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect()}
    lost = [a for a, b in pairs.items() if got[a] != (a, 1) or got[b] != (a, 1)]
    assert len(lost) <= 1
    assert all(got[i] == (i, 0) for i in range(2500))


def brute_forest(labels, depth, threshold, recall, crowd):
    """Per class and tree, the length of the prefix that is matched, by walking all tries."""
    import math
    from collections import Counter

    n, trees = len(labels), len(labels[0])
    count = [Counter(tuple(x[t][:d]) for x in labels for d in range(1, len(x[t]) + 1)) for t in range(trees)]
    size = lambda i, t, d: count[t][tuple(labels[i][t][:d])]
    miss = {d: math.log1p(-(threshold**d)) for d in range(depth, depth + 3)}
    used = [[depth if size(i, t, depth) <= crowd else depth + 1 if size(i, t, depth + 1) <= crowd else depth + 2 for t in range(trees)] for i in range(n)]
    given = [0] * n
    active = [set() for _ in range(trees)]
    for i in range(n):
        now = sum(miss[d] for d in used[i])
        deep = sorted((t for t in range(trees) if used[i][t] == depth + 2), key=lambda t: size(i, t, depth + 1))
        while now > math.log(1 - recall) and given[i] < len(deep):
            t = deep[given[i]]
            active[t].add(tuple(labels[i][t][: depth + 1]))
            now += miss[depth + 1] - miss[depth + 2]
            given[i] += 1
    return [[depth + 1 if used[i][t] == depth + 2 and tuple(labels[i][t][: depth + 1]) in active[t] else used[i][t] for t in range(trees)] for i in range(n)], given


def test_forest_shortens_prefixes_until_the_recall(spark, monkeypatch):
    """Every class reaches the target recall, and pairs meet where the walk over all tries says."""
    import math

    monkeypatch.setattr(ngram_join, "CROWD", 6)
    monkeypatch.setattr(ngram_join, "TREES", 12)
    rng = random.Random(4)
    recall, threshold, depth = 0.9, 0.8, 6
    family = [[rng.randrange(3) for _ in range(8)] for _ in range(12)]
    labels = [[[b if rng.random() < 0.93 else rng.randrange(9) for b in tree] for tree in family] for _ in range(80)]
    labels += [[[rng.randrange(10**6) for _ in range(8)] for _ in range(12)] for _ in range(20)]
    code = lambda *x: hash(x) % 2**62
    rows = [(i, [code(t, *x[t][:6]) for t in range(12)], [(x[t][6] << 32) | x[t][7] for t in range(12)]) for i, x in enumerate(labels)]
    reps = spark.createDataFrame(rows, "id long, prefixes array<long>, tails array<long>").repartition(3)
    got = {}
    for r in ngram_join.forest_nodes(reps, depth, threshold, recall).collect():
        got.setdefault(r.node, set()).add(r.id)
    used, given = brute_forest(labels, depth, threshold, recall, 6)
    want = {}
    for i, x in enumerate(labels):
        assert sum(math.log1p(-(threshold ** used[i][t])) for t in range(12)) <= math.log(1 - recall) + 1e-9
        for t in range(12):
            want.setdefault((t, *x[t][: used[i][t]]), set()).add(i)
    assert max(given) > 0 and {8} <= {d for u in used for d in u}
    sets = lambda groups: sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert sets(got) == sets(want)


def test_ids_that_are_missing_repeated_or_texts(spark):
    base = [f"w{k}" for k in range(40)]
    near = [*base[:-1], "other"]
    rows = [("b", " ".join(base)), ("a", " ".join(near)), (None, " ".join(base)), ("c", "something else"), ("c", "of another kind"), (None, "alone here"), (None, " ".join([*near[:-1], "third"])), (None, None), ("d", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("digest", F.lit("x")).withColumn("number", F.lit(1)).withColumn("h", F.lit(2)).repartition(3)
    got = sorted((tuple(r)[:4] for r in ngram_jaccard_join(docs).collect()), key=str)
    want = [("b", "a", 3, 2), ("a", "a", 3, 1), (None, "a", 3, 2), ("c", "c", 0, 1), ("c", "c", 0, 1), (None, None, 0, 1), (None, "a", 3, 1), (None, "d", 1, 2), ("d", "d", 1, 2)]
    assert got == sorted(want, key=str)


def test_short_texts_are_told_apart_by_words(monkeypatch):
    """Equal hashes of different short texts don't make copies."""
    assert len(set(ngram_join.digests(["a b", "b a", "a  B", "a b c d e", "a b c d", "", " ", None], 5))) == 5
    monkeypatch.setattr(ngram_join.xxhash, "xxh64_intdigest", lambda w: 7)
    assert len(set(ngram_join.digests(["one", "two", "one two three four five", "one two three four six"], 5))) == 4


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(9, None), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in list(parent)}


def brute_mix(docs, share, weights, max_epochs, seed, cuts=None):
    """Budgets by stepwise filling; documents by sorting each leaf. ``cuts`` gets the tokens of documents that the budget ends in."""
    import hashlib
    from collections import defaultdict

    def domain(s):
        return "curated" if hashlib.md5((s or "").encode()).hexdigest()[0] < "8" else "web"

    leaves = defaultdict(list)
    for i, text, lang, source in docs:
        n = text.count(" ") + 1 if text else 0
        leaves[domain(source), lang or "", source or ""].append((i, n))
    weight = lambda path: weights.get(path, 1.0)
    capacity = {}
    for path, rows in leaves.items():
        c = sum(n for _, n in rows) * max_epochs
        for k in range(3, 0, -1):
            c = c if weight(path[:k]) > 0 else 0
        for k in range(4):
            capacity[path[:k]] = capacity.get(path[:k], 0) + c

    def fill(budget, nodes):
        out, open_ = {}, set(nodes)
        while open_:
            level = (budget - sum(out.values())) / max(sum(weight(x) for x in open_), 1e-300)
            full = {x for x in open_ if capacity[x] <= level * weight(x) * (1 + 1e-12)}
            if not full:
                return out | {x: level * weight(x) for x in open_}
            out |= {x: capacity[x] for x in full}
            open_ -= full
        return out

    budgets = {(): min(int(share * sum(n for r in leaves.values() for _, n in r)), capacity.get((), 0))}
    for k in range(1, 4):
        for parent in [p for p in capacity if len(p) == k - 1]:
            budgets |= fill(budgets[parent], [p for p in capacity if len(p) == k and p[:-1] == parent])
    copies = {}
    for path, rows in leaves.items():
        total, b = sum(n for _, n in rows), int(budgets[path] + 1e-6)
        epochs = b // total if total else 0
        rest, through = b - epochs * total, 0
        key = lambda i: (int(hashlib.md5(f"{seed}:{epochs}:{i}".encode()).hexdigest()[:15], 16), i)  # noqa: B023, E731
        for i, n in sorted(rows, key=lambda r: key(r[0])):
            if cuts is not None and through < rest < through + n:
                cuts[i] = rest - through
            through += n
            copies[i] = epochs + (1 if rest > 0 and through <= rest else 0)
    return copies


@pytest.mark.parametrize(("share", "max_epochs", "weights"), [(0.5, 1, {}), (0.9, 1, {("web",): 3.0, ("curated", "en"): 5.0}), (1.5, 3, {("web",): 0.5, ("curated", "de", "s3"): 0.0}), (5.0, 2, {}), (0.9, 4, {("web",): 0.0})])
def test_mix_matches_brute_force(spark, share, max_epochs, weights):
    rng = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(rng.choice([1, 5, 50, 400]))), rng.choice(["en", "de", None]), rng.choice(["s0"] * 6 + [f"s{k}" for k in range(9)] + [None])) for i in range(900)]
    docs += [(9000, None, "en", "s1"), (9001, "", "fr", "empty")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(6)
    rows, cuts = mix(df, share, weights, max_epochs, seed=3).collect(), {}
    assert {r.doc_id: r.copies for r in rows} == brute_mix(docs, share, weights, max_epochs, 3, cuts)
    assert {r.doc_id: r.cut_tokens for r in rows if r.cut_tokens} == cuts
    assert mix(df.limit(0), share, weights, max_epochs).count() == 0


def test_mix_takes_the_whole_budget(spark, monkeypatch):
    """To the token; with clashing columns, hot and cold leaves, and leaves looked up by shuffle."""
    from tessera.operators import skew

    monkeypatch.setattr(skew, "HOT_GROUPS", 20)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(6)
    docs = [(i, " ".join("w" for _ in range(rng.choice([1, 7, 60]))), rng.choice(["en", "de"]), rng.choice(["s0"] * 200 + [f"s{k}" for k in range(150)])) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5)
    for c in ("leaf", "rest", "n_docs", "key", "id", "cut_key", "domain", "copies"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    try:
        rows, cuts = mix(df, 0.5, {}, 2, seed=3).collect(), {}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert {r.doc_id: r.copies for r in rows} == brute_mix(docs, 0.5, {}, 2, 3, cuts)
    assert all((r.leaf, r.rest, r.n_docs, r.key, r.id) == ("own leaf", "own rest", "own n_docs", "own key", "own id") for r in rows)
    budget = sum(t.count(" ") + 1 for _, t, *_ in docs) // 2
    # A leaf's budget is whole tokens: at most one is lost for each.
    leaves = len({(r.domain, r.lang, r.source) for r in rows})
    assert budget - leaves <= sum(r.copies * r.tokens + r.cut_tokens for r in rows) <= budget


def test_mix_repeated_and_missing_ids(spark):
    docs = [(7, "a b c d", "en", "s")] * 2 + [(None, "a b", "en", "s")] * 2 + [(k, "w " * 9 + "w", "en", "s") for k in range(20, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    rows = mix(df, 0.6, {}, 1).collect()
    assert len(rows) == len(docs)
    for i in (7, None):
        assert len({r.copies for r in rows if r.doc_id == i}) == 1
    taken = sum(r.copies * r.tokens + r.cut_tokens for r in rows)
    assert 0 <= int(0.6 * 212) - taken < 8


def test_word_count(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,), (" ",)], "t string")
    assert [r[0] for r in df.select(word_count(df.t)).collect()] == [3, 0, 0, 2]


