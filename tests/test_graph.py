import pytest
from pyspark.sql import functions as F

from tessera.functions import vocab
from tessera.operators import graph_queries as Q
from tessera.operators.resolve import resolve_calls, resolve_names
from tessera.plans.registry import PROJECT, PROJECT_DEAD, PROJECT_EDGES, PROJECT_NODES
from tessera.sources.store import GraphStore


@pytest.fixture
def graph(spark):
    def make(nodes, edges):
        nodes = [(n[0], n[1], n[2] if len(n) > 2 else None) for n in nodes]
        return spark.createDataFrame(nodes, vocab.NODES), spark.createDataFrame(edges, vocab.EDGES)

    return make


def ids(df):
    return {r[0] for r in df.collect()}


def fn(*names):
    return [(n, "function", n) for n in names]


def test_dead_functions(graph):
    n, e = graph([("m", "function", "main"), *fn("foo", "bar", "baz"), ("t", "function", "test::x"), ("b", "function", "bench::y"), ("p", "function", "pub::z"), ("q", "function")], [("m", "foo", "calls"), ("foo", "bar", "calls"), ("bar", "foo", "calls"), ("baz", "baz", "calls"), ("m", "q", "contains")])
    assert ids(Q.dead_functions(n, e)) == {"baz", "q"}


def test_blast_radius(graph):
    n, e = graph([("a", "file"), ("b", "file")], [("a", "b", "changes_with")])
    assert ids(Q.blast_radius(n, e, "a")) == {"b"} and ids(Q.blast_radius(n, e, "b")) == {"a"}
    n, e = graph([("a", "file"), ("b", "file"), ("c", "file")], [("a", "b", "calls"), ("b", "c", "calls")])
    assert ids(Q.blast_radius(n, e, "a")) == {"b", "c"} and ids(Q.blast_radius(n, e, "c")) == {"b"}
    n, e = graph([("f", "file"), *fn("x", "y", "z")], [("f", "x", "contains"), ("f", "y", "contains"), ("f", "z", "contains"), ("x", "y", "calls"), ("x", "gone", "calls")])
    assert ids(Q.blast_radius(n, e, "x")) == {"f", "y"}
    assert [r.id for r in Q.blast_radius(n, e, "f", limit=2).collect()] == ["x", "y"]


def test_callers(graph):
    n, e = graph(fn("a", "b", "c", "d"), [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("d", "c", "calls")])
    assert ids(Q.callers(n, e, "c", 1)) == {"b", "d"} and ids(Q.callers(n, e, "c", 0)) == {"b", "d"}
    assert ids(Q.callers(n, e, "c", 2)) == {"a", "b", "d"} and ids(Q.callers(n, e, "c", 1000)) == {"a", "b", "d"}
    assert ids(Q.callers(n, e, "none", 3)) == set()


def test_node_info(graph):
    n, e = graph([("n1", "function", "foo"), ("n2", "function")], [("n1", "n2", "calls"), ("n1", "n1", "references"), ("n1", "gone", "calls")])
    info = Q.node_info(n, e, "n1").first()
    assert (info.node_type, info.payload) == ("function", "foo")
    assert {tuple(x) for x in info.outgoing_edges} == {("n2", "calls", "function", None), ("n1", "references", "function", "foo")}
    assert [x.id for x in info.incoming_edges] == ["n1"]
    assert Q.node_info(n, e, "none").first() is None


def test_implementors_and_modules(graph):
    n, e = graph([("t", "trait", "Draw"), ("u", "trait", "Redraw"), ("i", "impl", "Draw"), ("j", "impl"), ("f", "file"), ("m", "module", "x"), ("c", "crate_root")], [("i", "t", "implements_trait"), ("j", "u", "implements_trait"), ("f", "m", "contains"), ("c", "f", "contains"), ("f", "i", "contains")])
    assert ids(Q.trait_implementors(n, e, "Draw")) == {"i"} and ids(Q.trait_implementors(n, e, "")) == {"i", "j"}
    assert [tuple(r) for r in Q.module_graph(n, e).collect()] == [("c", "f", "crate_root", "file"), ("f", "m", "file", "module")]
    assert Q.module_graph(n, e, "m").count() == 1 and Q.module_graph(n, e, "").count() == 2


def test_search(graph):
    n, _ = graph([*[(f"m{k}", "function", f"match{k}") for k in range(5)], ("M", "function", "Main"), ("x", "file")], [])
    page, total = Q.text_search(n, "match", limit=2, offset=1)
    assert [r.id for r in page.collect()] == ["m1", "m2"] and total == 5
    assert Q.text_search(n, "main")[1] == 0 and Q.text_search(n, "MAIN", True)[1] == 1 and Q.text_search(n, "")[1] == 6


def test_change_coupling(spark):
    commits = spark.createDataFrame([("c", 0, "b.rs"), ("c", 0, "a.rs"), ("c", 0, "x.txt"), ("d", 1, "a.rs"), ("d", 1, "b.rs"), ("e", 2, "a.rs")], "commit_id string, seq int, path string")
    assert [tuple(r) for r in Q.change_coupling(commits).collect()] == [("./a.rs", "./b.rs", "changes_with")]


A, B, C = "./a.rs", "./b.rs", "./c.rs"
FUNCTIONS = [(f"{A}#1:1", "function", "pub::one"), (f"{A}#2:1", "function", "twice"), (f"{A}#3:1", "function", "test::twice"), (f"{B}#1:1", "function", "far"), (f"{C}#1:1", "function", "far"), (f"{C}#2:1", "function", "only")]


@pytest.mark.parametrize(
    ("target", "imports", "want"),
    [
        (f"{A}::one", [], f"{A}#1:1"),
        (f"{A}::sub::one", [], f"{A}#1:1"),
        (f"{A}::std::mem::only", [], None),
        (f"{A}::twice", [], None),
        (f"{A}::far", [], None),
        (f"{A}::only", [], f"{C}#2:1"),
        ("one", [], f"{A}#1:1"),
        ("only", [], f"{C}#2:1"),
        (f"{A}::only", [B], None),
        (f"{A}::far", [B], f"{B}#1:1"),
        (f"{A}::far", [B, C], None),
        (f"{A}::far", [f"{C}#1:1"], f"{C}#1:1"),
        (f"{A}::far", [B, f"{B}#1:1"], None),
        (f"{A}::one", [B], f"{A}#1:1"),
    ],
)
def test_resolve_calls(graph, target, imports, want):
    n, e = graph(FUNCTIONS, [(f"{A}#1:1", target, "calls"), *[(A, i, "imports") for i in imports]])
    assert ids(resolve_calls(n, e).select("to_id")) == ({want} if want else set())


TYPES = [(f"{A}#1:1", "struct", "One"), (f"{A}#2:1", "struct", "Two"), (f"{A}#3:1", "enum", "Two"), (f"{B}#1:1", "struct", "Far"), (f"{C}#1:1", "struct", "Far"), (f"{C}#2:1", "trait", "Only"), (f"{C}#3:1", "function", "One")]


@pytest.mark.parametrize(
    ("target", "imports", "want"),
    [
        (f"{A}::One", [], f"{A}#1:1"),
        (f"{A}::Two", [], None),
        (f"{A}::Far", [], None),
        (f"{A}::Only", [B], f"{C}#2:1"),
        (f"{A}::Far", [C, B], f"{B}#1:1"),
        (f"{A}::Far", [f"{C}#1:1"], f"{C}#1:1"),
        (f"{A}::Only", [C], f"{C}#2:1"),
        (f"{C}#9:9", [], f"{C}#9:9"),
        ("Only", [], "Only"),
        (f"{A}::m::One", [], None),
    ],
)
def test_resolve_names(graph, target, imports, want):
    n, e = graph(TYPES, [(f"{A}#1:1", target, "references"), *[(A, i, "imports") for i in imports]])
    assert ids(resolve_names(n, e, "references", ("struct", "enum", "trait", "type_alias")).select("to_id")) == ({want} if want else set())


def test_vocab(spark):
    with pytest.raises(ValueError):
        vocab.check("nothing", vocab.NODE_TYPES)
    df = spark.createDataFrame([("pub::test::a",), ("bench::pub::b",), ("c",), ("pubs::d",)], "p string")
    assert [r[0] for r in df.select(vocab.canonical_name(F.col("p"))).collect()] == ["a", "b", "c", "pubs::d"]
    paths = spark.createDataFrame([("./src/lib.rs",), ("./src/main.rs",), ("./src/a/b.rs",), ("./src/a/mod.rs",), ("./crate_a/src/lib.rs",)], "p string")
    assert [r[0] for r in paths.select(vocab.module_path(F.col("p"))).collect()] == ["crate", "crate", "crate::a::b", "crate::a", "crate::crate_a::src::lib"]
    nan = float("nan")
    assert vocab.json_value([nan, 1.5, True, None, b"\x01", {"a": float("inf")}, "x"]) == [None, 1.5, True, None, [1], {"a": None}, "x"]


@pytest.mark.parametrize(("glob", "hit", "miss"), [("src/**", "src/lib.rs#1:1", "tests/x"), ("*.rs#*", "a/b.rs#1:2", "a.txt"), ("**/x[!a]?", "p/q/xbc", "xab"), ("a.b", "a.b", "axb"), ("**/m.rs", "m.rs", "xm.rs")])
def test_glob(glob, hit, miss, spark):
    df = spark.createDataFrame([(hit,), (miss,)], "s string")
    assert [r[0] for r in df.where(F.col("s").rlike(vocab.glob_regex(glob))).collect()] == [hit]


def test_bad_globs():
    for g in ("a**", "***", "[a"):
        with pytest.raises(ValueError):
            vocab.glob_regex(g)


def test_store(spark, tmp_path):
    for path in (None, str(tmp_path / "g")):
        s = GraphStore(spark, path)
        s.put_nodes([("a", "file", None), ("b", "function", "x"), ("b", "function", "y")])
        s.put_node("a", "module", "m")
        s.put_edges([("a", "b", "contains"), ("a", "b", "contains"), ("b", "b", "calls")])
        s.put_dead(["b"])
        assert {tuple(r) for r in s.nodes.collect()} == {("a", "module", "m"), ("b", "function", "y")}
        assert (s.node_count(), s.edge_count()) == (2, 2)
        s.remove_edge("b", "b", "calls")
        s.remove_edge("no", "no", "calls")
        assert s.edge_count() == 1
        with pytest.raises(ValueError):
            s.put_node("z", "nothing")
    again = GraphStore(spark, str(tmp_path / "g"))
    assert again.node_count() == 2 and ids(again.dead_functions) == {"b"} and again.indexed_at() > 1_600_000_000
    other = GraphStore(spark)
    other.tables["nodes"] = spark.createDataFrame([("n", "weird", None), ("a", "file", "new")], vocab.NODES)
    other.tables["edges"] = spark.createDataFrame([("n", "a", "odd"), ("n", "a", "calls")], vocab.EDGES)
    again.copy_from(other)
    assert {tuple(r) for r in again.nodes.collect()} == {("a", "file", "new"), ("b", "function", "y")} and again.edge_count() == 2
    again.clear_dead()
    assert again.dead_functions.count() == 0
    again.clear()
    assert GraphStore(spark, str(tmp_path / "g")).node_count() == 0
    assert len([p for p in (tmp_path / "g").iterdir() if p.name.startswith("snapshot")]) == 1


def test_project_graph(spark):
    from tessera.plans.indexing import build_graph

    nodes, edges, dead = build_graph(spark.createDataFrame(list(PROJECT.items()), "file_id string, content string"))
    assert {tuple(r) for r in nodes.collect()} == set(PROJECT_NODES)
    assert {tuple(r) for r in edges.collect()} == set(PROJECT_EDGES)
    assert {tuple(r) for r in dead.collect()} == set(PROJECT_DEAD)
