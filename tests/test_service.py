import io
import json
import subprocess

import pytest

from tessera.plans import cli
from tessera.plans.datalog import DatalogError, run_script
from tessera.plans.registry import PROJECT
from tessera.plans.service import InvalidParams, Service, clean_script, respond, serve
from tessera.sources.git_history import read_history
from tessera.sources.source_files import list_sources, scan_sources


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in PROJECT.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


@pytest.fixture(scope="module")
def service(spark, project):
    s = Service(spark, str(project / "db"))
    assert s.call("reindex", {"path": str(project)})["ok"]
    return s


def test_tools(service):
    assert service.call("status")["node_count"] == 15
    dead = service.call("dead_code", {"limit": 2, "offset": 1})
    assert (dead["count"], dead["total_filtered"], dead["source"]) == (2, 3, "stored")
    assert service.call("dead_code", {"file": "./src/util*"})["dead_node_ids"] == ["./src/util.rs#9:1"]
    assert service.call("dead_code", {"node_type": "struct"})["count"] == 0
    assert service.call("dead_code", {"limit": "x"})["limit"] == 100 and service.call("dead_code", {"limit": 99999})["limit"] == 10000
    assert {x["id"] for x in service.call("callers", {"node_id": "./src/util.rs#5:1", "depth": 3})["callers"]} == {"./src/shapes.rs#6:5"}
    assert service.call("search", {"query": "AREA", "case_insensitive": True})["total"] == 3
    assert service.call("trait_implementors", {"trait_name": "Are"})["count"] == 1
    assert service.call("module_graph", {})["count"] == 2
    assert service.call("blast_radius", {"node_id": "./src/shapes.rs#12:1"})["count"] == 3
    info = service.call("node_info", {"node_id": "./src/lib.rs"})
    assert "payload" not in info and len(info["outgoing_edges"]) == 5
    assert service.call("node_info", {"node_id": "nope"}) == {"error": "Node not found", "node_id": "nope"}
    answer = service.call("query", {"script": '?[id] := *nodes[id, "module", _]\n:limit 1', "limit": 5})
    assert answer["headers"] == ["id"] and answer["count"] == 2


def test_errors(service, spark, tmp_path):
    for tool in ("callers", "blast_radius", "search", "node_info", "query", "trait_implementors"):
        with pytest.raises(InvalidParams):
            service.call(tool, {})
    with pytest.raises(InvalidParams):
        service.call("dead_code", {"file": "a**"})
    with pytest.raises(KeyError):
        service.call("nothing")
    with pytest.raises(FileNotFoundError):
        Service(spark, str(tmp_path / "none")).call("nothing")
    assert service.call("reindex", {"path": "/no/such"})["error"]


def test_clean_script():
    assert clean_script("?[a] := *nodes[a]\n:limit 7\n", 3) == "?[a] := *nodes[a]\n:limit 3"
    for bad in (":put nodes {}", " : RM x", ":create[", "a\n:remove"):
        with pytest.raises(InvalidParams):
            clean_script(bad, 1)
    assert ":putter" in clean_script(":putter x", 1)


def test_json_rpc(service):
    out = io.StringIO()
    calls = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "status"}}, {"id": 4, "method": "resources/read", "params": {"uri": "tessera://status"}}, {"id": 5, "method": "tools/call", "params": {"name": "callers"}}, {"id": 6, "method": "none"}]
    serve(service, io.StringIO("\n".join(map(json.dumps, calls)) + "\nnot json\n"), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, 5, 6, None]
    assert len(answers[1]["result"]["tools"]) == 10 and answers[2]["result"]["structuredContent"]["node_count"] == 15
    assert [answers[k]["error"]["code"] for k in (4, 5, 6)] == [-32602, -32601, -32700]
    assert respond(service, {"id": 9, "method": "resources/list"})["result"]["resources"]


def test_cli(spark, project, tmp_path, capsys):
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)[1]
    db = str(tmp_path / "g")
    assert "No graph at" in run("status", db)
    assert "15 nodes" in run("index", str(project))
    assert "Indexed" in run("index", str(project), "-o", db)
    assert "nodes: 15" in run("status", db)
    assert run("search", "-d", db, "HELPER", "-c") == "./src/lib.rs#13:1\tfunction\thelper\n"
    assert run("query", "-d", db, '?[id, p] := *nodes[id, "file", p]').splitlines()[0] == "./src/lib.rs\tnull"
    with pytest.raises(SystemExit):
        run("query", "-d", str(tmp_path / "none"), "?[a] := *nodes[a, _, _]")
    with pytest.raises(FileNotFoundError):
        run("index", "/no/such/root")


def test_discovery(spark, tmp_path):
    for name in ("a.rs", "sub/b.rs", "sub/c.txt", ".hidden/d.rs", ".e.rs", "skip/f.rs", "sub/gen_x.rs", "sub/keep/gen_y.rs", "_g.rs"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("fn x() {}\r\n")
    (tmp_path / ".ignore").write_text("# note\nskip/\ngen_*\n!gen_y.rs\n")
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe")
    (tmp_path / ".gitignore").write_text("a.rs\n")
    assert list_sources(str(tmp_path)) == ["_g.rs", "a.rs", "bad.rs", "sub/b.rs", "sub/keep/gen_y.rs"]
    (tmp_path / ".git").mkdir()
    assert "a.rs" not in list_sources(str(tmp_path))
    found = {r.file_id: r.content for r in scan_sources(spark, str(tmp_path)).collect()}
    assert set(found) == {"./_g.rs", "./sub/b.rs", "./sub/keep/gen_y.rs"} and found["./_g.rs"].endswith("\r\n")


def test_git_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    for turn in range(3):
        for name in ("a.rs", "b.rs")[: 1 + turn % 2]:
            (tmp_path / name).write_text(str(turn))
        git("add", ".")
        git("commit", "-qm", f"c{turn}")
    rows = {(r.seq, r.path) for r in read_history(spark, str(tmp_path)).collect()}
    assert rows == {(0, "a.rs"), (1, "a.rs"), (1, "b.rs")}


def test_watch(spark, project, tmp_path):
    import shutil
    import time

    from tessera.sources.store import GraphStore
    from tessera.streaming.watch import watch

    root = tmp_path / "w"
    shutil.copytree(project / "src", root / "src")
    said = []
    store = GraphStore(spark, str(tmp_path / "g"))
    query = watch(spark, str(root), store, interval="1 second", say=said.append)
    try:
        (root / "src" / "util.rs").unlink()
        until = time.time() + 90
        while not said and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert said[:1] == [f"Re-indexed {root}"]
    assert GraphStore(spark, str(tmp_path / "g")).nodes.where("type = 'file'").count() == 2


@pytest.fixture
def stored(spark):
    nodes = spark.createDataFrame([("a", "function", "main"), ("b", "function", "x"), ("c", "file", None)], "id string, type string, payload string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "a", "calls"), ("c", "a", "contains")], "from_id string, to_id string, edge_type string")
    return {"nodes": nodes, "edges": edges}


@pytest.mark.parametrize(
    ("script", "want"),
    [
        ('?[id] := *nodes[id, "file", _]', {("c",)}),
        ("?[id] := *nodes[id, t, p], t != 'file', is_null(p)", set()),
        ("?[id] := *nodes[id, t, p], p == null", {("c",)}),
        ('?[x] := *edges[x, y, "calls"], (y == "b" or y == "zzz")', {("a",)}),
        ("?[id, n] := *nodes[id, _, p], n = length(p)", {("a", 4), ("b", 1), ("c", None)}),
        ('p[x, y] := *edges[x, y, "calls"]\np[x, z] := p[x, y], p[y, z]\n?[x, y] := p[x, y]', {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}),
        ('even[x] := *nodes[x, _, "main"]\nodd[y] := even[x], *edges[x, y, "calls"]\neven[y] := odd[x], *edges[x, y, "calls"]\n?[x] := odd[x]', {("b",)}),
        ("?[count(id)] := *nodes[id, _, _]", {(3,)}),
        ('?[count(id)] := *nodes[id, "none", _]', {(0,)}),
        ("?[t, count(id)] := *nodes[id, t, _]", {("function", 2), ("file", 1)}),
        ('?[id] := *nodes[id, _, _], not *edges[_, id, "calls"]', {("c",)}),
        ('?[id] := id in ["a", "q"], *nodes[id, _, _]', {("a",)}),
        ('?[x] := x in ["a", "q"]', {("a",), ("q",)}),
        ("?[x, y] := x = 1 + 2 * 3, y = x - 1", {(7, 6)}),
        ("?[id] := *nodes[id, _, _]\n:limit 1\n:offset 1", {("b",)}),
        ('d[a, b] <- [["a", 1], ["b", null]]\n?[a, b] := d[a, b], *nodes[a, _, _]', {("a", 1), ("b", None)}),
        ("?[a, b] := *nodes[a, t, _], *nodes[b, t, _], a < b  # pairs", {("a", "b")}),
    ],
)
def test_datalog(spark, stored, script, want):
    assert {tuple(r) for r in run_script(spark, stored, script).collect()} == want


@pytest.mark.parametrize(
    "script",
    ["", "?[a]", "?[a] := *none[a]", "?[z] := *nodes[a, _, _]", "?[a] := *nodes[a, _]", "?[a] := b[a]", ":put nodes {a}", "?[a] := not *nodes[a, _, _]", "p[a] := *nodes[a, _, _], not p[a]\n?[a] := p[a]", "?[a] := *nodes[a, _, _], foo(a)", "?[sum(a)] := *nodes[a, _, _]", "?[a] := *nodes[a, _, $x]", "?[a] := *nodes[a, _, _\n", "?[a] := p[a]\np[a] := p[a]", "d[a] <- [[1], ['x']]\n?[a] := d[a]"],
)
def test_datalog_rejects(spark, stored, script):
    with pytest.raises(DatalogError):
        run_script(spark, stored, script)


def test_datalog_parameters(spark, stored):
    assert [r[0] for r in run_script(spark, stored, "?[a] := *nodes[a, _, _], a in $ids", {"ids": ["b", "z"]}).collect()] == ["b"]
