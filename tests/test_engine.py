"""Graph, ranking, search, packing, resolution, incremental indexing, sources, streams and tools."""

import json
from datetime import datetime, timedelta
from threading import Event

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codeweft import cli, pipeline, session, tools
from codeweft.functions import text
from codeweft.operators import graph, incremental, pack, pagerank, resolve, search
from codeweft.schemas import EDGES, FS_EVENTS, NODES
from codeweft.plans import reference
from codeweft.sources import repository, store
from codeweft.streaming import watch


def N(spark, *ids, **symbols):
    data = [(i, "file", i.removeprefix("file:"), None, 0, 0) for i in ids]
    data += [(i, "symbol", v.get("path", "p.go"), (v.get("name", i), v.get("q", i), "function", "go", v.get("sig", f"func {i}()"), v.get("doc", ""), v.get("body", "")), 0, 0) for i, v in symbols.items()]
    return spark.createDataFrame(data, NODES)


def E(spark, *edges):
    return spark.createDataFrame([(*e, 1.0)[:4] if len(e) < 4 else e for e in [(x if len(x) > 2 else (*x, "CALLS")) for x in edges]], EDGES)


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text_functions(spark):
    L = F.lit
    assert value(spark, text.tokenize_query(L("Fix JWT token refresh in AuthController"))) == ["jwt", "token", "refresh", "authcontroller", "auth", "controller"]
    assert value(spark, text.tokenize_query(L("a_b parseHTTP__x2 the"))) == ["a_b", "parsehttp__x2", "parse", "http", "x2"]
    assert [value(spark, text.token_estimate(L(t))) for t in ("", None, "abcd", "abcde", "a b c d", "\u00a0\u2003")] == [0, 0, 1, 2, 4, 1]
    assert [value(spark, text.base_name(L(t))) for t in ("a.b.c", "c", "a.", " x.y ", "")] == ["c", "c", "a.", "y", ""]
    assert [value(spark, text.risk(L(n))) for n in (0, 1, 4, 5, 10, 11)] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    assert [value(spark, text.is_test_file(L(p))) for p in ("a/tests/x.py", "tests/x.py", "test_x.py", "x.spec.ts", "x.spec.tsx", "A_TEST.go")] == [True, False, True, True, False, True]
    assert [value(spark, text.is_ignored(L(p), L(n))) for p, n in (("main.go", 1), ("a/node_modules/x.js", 1), (".env", 1), ("x.PNG", 1), ("b.go", 1024 * 1024 + 1), ("build", 1), ("Vendor/x.go", 1), ("r.md", None))] == [False, True, True, True, True, True, True, False]
    assert [value(spark, text.imports_path(L(i), L(p))) for i, p in (("./", "a/b.go"), (".", "a/b"), ("x.", "root.go"), ("lib/b", "a/b/c"), ("zz", "a/b"))] == [True, False, True, True, False]
    assert value(spark, text.location(L("p"), L(1), L(2), L(3), L(4))) == "p:1:2-3:4"
    assert [value(spark, text.fence(L(p))) for p in ("a.tsx", "a.java", "a")] == ["typescript", "", ""]


def test_pagerank_triangle(spark):
    nodes, edges = N(spark, A={}, B={}, C={}), E(spark, ("A", "B"), ("C", "B"))
    seeds = spark.createDataFrame([("A", 1.0), ("C", 1.0), ("gone", 5.0)], "id string, weight double")
    got = {r.id: r.score for r in pagerank.pagerank(nodes, edges, seeds).collect()}
    assert got == pytest.approx({"B": 0.467361156, "A": 0.266319422, "C": 0.266319422}, abs=1e-8)
    five = {r.id: r.score for r in pagerank.pagerank(nodes, edges, seeds, iterations=5).collect()}
    assert five["B"] == pytest.approx(0.663324062, abs=1e-8) and sum(five.values()) == pytest.approx(1)
    lost = pagerank.pagerank(nodes, E(spark, ("A", "B"), ("C", "missing")), seeds, damping=7, iterations=-1, tolerance=-1)
    assert sum(r.score for r in lost.collect()) < 0.99
    assert pagerank.pagerank(nodes.limit(0), edges, seeds).count() == 0


def test_hops_and_impact(spark):
    nodes = N(spark, a={}, b={}, c={}, d={"path": "x/tests/d_test.go"})
    edges = E(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("b", "gone"), ("gone", "d"), ("d", "d"), ("d", "c", "REFERENCES"), ("a", "b"))
    start = spark.createDataFrame([("a",), (None,)], "start string")
    assert rows(graph.khop(nodes, edges, start, 9), "node_id", "hop") == [("b", 1), ("c", 2)]  # gone is not gone on from
    assert rows(graph.khop(nodes, edges, start, 0, "incoming"), "node_id") == [("c",)]
    assert rows(graph.khop(nodes, edges, start, 1, "both"), "node_id") == [("b",), ("c",)]
    assert rows(graph.khop(nodes, edges, start, 1, "sideways")) == []
    assert rows(graph.khop(nodes, edges, start, 2, "outgoing", ["REFERENCES"])) == []
    s = graph.impact_summary(nodes, edges, "c", 3).first()
    assert (s.total, s.direct, s.transitive, s.files, s.test_files, s.risk) == (4, 2, 1, 2, 1, "MEDIUM")
    assert [r.caller for r in graph.callers(nodes, edges, "b").collect()] == ["a", "a"]
    assert [r.caller for r in graph.callers(nodes, edges.limit(0), "b").collect()] == [None]
    n, e = graph.remove_files(nodes, edges, spark.createDataFrame([("x/tests/d_test.go",)], "file_path string"))
    assert n.count() == 3 and e.count() == 5
    assert tuple(graph.summary(nodes, E(spark, ("a", "gone"), ("gone", "a"))).first()) == (0, 4, 1)


def test_search_and_pack_two_symbols(spark):
    nodes = N(
        spark,
        ValidateToken={"path": "auth.go", "sig": "func ValidateToken(token string) bool", "doc": "Validates the JWT token", "body": "return HashToken(token) != \"\""},
        HashToken={"path": "crypto.go", "sig": "func HashToken(t string) string", "body": "return sha256(t)"},
    )
    got = {r.id: (r.score, r.reason) for r in search.score(nodes, "ValidateToken").collect()}
    assert got["ValidateToken"][0] == 27 and got["HashToken"][0] == 7 and got["HashToken"][1] == "partial_symbol_name,signature_match,path_or_doc_match"
    assert search.score(nodes, "the of").count() == 0
    edges = E(spark, ("ValidateToken", "HashToken"))
    ranked = pagerank.pagerank(nodes, edges, search.seeds(nodes, "ValidateToken"))
    scores = {r.id: r.score for r in ranked.collect()}
    assert scores == pytest.approx({"HashToken": 0.525917201, "ValidateToken": 0.474082799}, abs=1e-8)
    items, used = pack.select(nodes, edges, ranked, 1000)
    assert [(r.id, r.mode) for r in items.orderBy("pos").collect()] == [("HashToken", "full"), ("ValidateToken", "full")]
    assert used == sum(r.token_count for r in items.collect()) <= 800
    out = pack.render(pack.contents(items, nodes), "ValidateToken", 1000, used)
    assert "ValidateToken" in out and "```go\nfunc HashToken(t string) string {\nreturn sha256(t)\n}\n```" in out


def test_pack_skips_and_continues_and_enriches(spark, monkeypatch):
    w = lambda n: " ".join(["w"] * n)
    nodes = N(spark, a={"sig": w(300)}, b={"sig": w(600)}, c={"sig": w(100)})
    ranked = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.3), ("x", 0.9)], "id string, score double")
    items, used = pack.select(nodes, E(spark, ("a", "b")), ranked, 650)
    assert rows(items, "pos", "id", "token_count") == [(0, "a", 300), (1, "c", 100)] and used == 400
    # the documentation does not fit, the bare signature does
    nodes = N(spark, a={"sig": w(50)}, b={"sig": w(30), "doc": w(500)})
    items, used = pack.select(nodes, E(spark, ("a", "b"), ("a", "b"), ("a", "gone")), ranked, 90)
    assert rows(items, "id", "mode", "relevance", "reason")[1] == ("b", "skeleton", 0.0, "1-hop dependency of a") and used == 80
    assert [pack.usable_budget(b) for b in (599, 600, 0, -3)] == [(599, 599), (600, 400), (3500, 3300), (3500, 3300)]
    monkeypatch.setattr(pack, "CHUNK", 1)
    assert pack.select(N(spark, a={"sig": w(300)}, b={"sig": w(600)}, c={"sig": w(100)}), E(spark, ("a", "b")), ranked, 650)[1] == 400
    assert pack.select(nodes.limit(0), E(spark), ranked, 90)[1] == 0


SYM = "file_path string, ordinal int, name string, qualified_name string, kind string, language string, signature string, documentation string, body string, calls array<string>, implements array<string>"


def S(spark, *data):
    return spark.createDataFrame([(p, o, n, q, "function", "go", f"func {n}", "", "é" * 4, c, i) for p, o, n, q, c, i in data], SYM)


def test_resolution_of_three_files(spark):
    s = S(spark, ("utils/helper.go", 0, "FormatString", "FormatString", [], []), ("service/service.go", 0, "ExecuteTask", "ExecuteTask", ["FormatString"], None), ("main.go", 0, "main", "main", ["service.ExecuteTask", None, " "], []))
    imports = spark.createDataFrame([("service/service.go", "utils"), ("main.go", "service"), ("main.go", None)], "file_path string, imp string")
    files = s.select("file_path").union(s.select("file_path"))
    edges = resolve.build_edges(s, imports, files, single=True)
    counts = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert counts == {"DEFINES": 3, "IMPORTS": 2, "CALLS": 2}
    assert {r.weight for r in edges.where("type = 'CALLS'").collect()} == {1.0}
    nodes = resolve.build_nodes(s, files)
    assert nodes.count() == 6 and nodes.where("id = 'sym:main.go::main'").first().token_cost == 2  # bytes, not characters
    impact = graph.impact_summary(nodes, edges, "FormatString").first()
    assert (impact.direct, impact.transitive, impact.files, impact.test_files, impact.risk) == (1, 1, 2, 0, "MEDIUM")


def test_resolution_prefers_the_file_and_keeps_duplicates(spark):
    s = S(spark, ("r/a.go", 0, "f", "A.f", ["f", "x.g", "x.g", "B.f"], ["T"]), ("r/a.go", 1, "f", "B.f", [], []), ("r/b.go", 0, "g", "g", ["f"], []), ("r/c.go", 0, "g", "g", [], ["g"]), ("q/c.go", 0, "T", "T", [], []))
    calls = rows(resolve.call_edges(s), "src", "dst", "weight")
    assert calls == sorted([("sym:r/a.go::f", "sym:r/a.go::f", 2.0)] * 2 + [("sym:r/a.go::f", f"sym:r/{x}.go::g", 1.0) for x in "bbcc"] + [("sym:r/b.go::g", "sym:r/a.go::f", 1.0)] * 2, key=repr)
    assert rows(resolve.implements_edges(s), "src", "dst") == [("sym:r/c.go::g", "sym:r/b.go::g"), ("sym:r/c.go::g", "sym:r/c.go::g")]
    assert resolve.build_nodes(s, s.select("file_path")).where("id = 'sym:r/a.go::f'").first().symbol.qualified_name == "B.f"
    assert resolve.build_edges(s.limit(0), spark.createDataFrame([], "file_path string, imp string"), s.select("file_path").limit(0)).count() == 0


def test_freshness(spark):
    c = "rel_path string, size long, mtime_ns long, checksum string"
    files = spark.createDataFrame([("same", 1, 1, "x"), ("sum", 1, 9, "x"), ("meta", 1, 1, "y"), ("new", 1, 1, "x"), ("null", None, 1, None), ("mod", 2, 1, "z")], c)
    cache = spark.createDataFrame([("same", 1, 1, "x"), ("sum", 2, 2, "x"), ("meta", 1, 1, "z"), ("null", None, 1, None), ("mod", 1, 1, "x"), ("gone", 1, 1, "x")], c)
    got = incremental.classify(files, cache)
    assert dict(rows(got)) == {"same": "cached", "sum": "cached", "meta": "cached", "new": "added", "null": "modified", "mod": "modified", "gone": "deleted"}
    assert tuple(incremental.stats(got).first()) == (6, 1, 2, 1, 3)


def test_deliveries_are_compared_within_their_repository(spark, tmp_path):
    c = "snapshot_no int, rel_path string, checksum string, loaded_at timestamp, size long, mtime_ns long"
    t = datetime(2024, 1, 1)
    data = [(1, "r/a", "1"), (1, "r/b", "1"), (1, "s/a", "1"), (2, "r/a", "2"), (2, "r/b", "1"), (3, "r/a", "2"), (3, "s/a", "1"), (3, "s/b", "1")]
    spark.createDataFrame([(*d, t, None, None) for d in data], c).write.parquet(str(tmp_path / "file_cache.parquet"))
    got = rows(reference.incremental_classify(spark, str(tmp_path)))
    # s lacks delivery 2, so its third is compared with its first; nothing is deleted in a delivery that does not exist
    assert got == sorted([(1, "r/a", "added"), (1, "r/b", "added"), (1, "s/a", "added"), (2, "r/a", "modified"), (2, "r/b", "cached"), (3, "r/a", "cached"), (3, "r/b", "deleted"), (3, "s/a", "cached"), (3, "s/b", "added")])
    assert tuple(reference.incremental_stats(spark, str(tmp_path)).first()) == (8, 4, 1, 1, 3)


def test_scratch_needs_a_shared_folder_and_leaves_nothing(spark, monkeypatch):
    s = session.Scratch(spark, "x")
    t = s.cut(spark.range(3))
    assert t.count() == 3
    s.close()
    assert not s._place(s.root)[0].exists(s._place(s.root)[1])

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere)


def test_index_lifecycle(spark, tmp_path, capsys):
    root = tmp_path / "work" / "build"  # the root's own name is not judged
    (root / "node_modules").mkdir(parents=True)
    (root / "helper.go").write_text("package main\n\n// Helper helps.\nfunc Helper() {}\n")
    (root / "main.go").write_text("package main\n\nfunc main() {\n\tHelper()\n}\n")
    (root / "node_modules/pkg.js").write_text("x")
    (root / "notes.md").write_text("no parser")
    cache = str(tmp_path / "cache")
    scanned = repository.scan(spark, str(root))
    assert rows(scanned, "rel_path", "ext") == [("helper.go", "go"), ("main.go", "go"), ("notes.md", "md")]

    def index(**kw):
        t, c = pipeline.index(spark, str(root), cache, **kw)
        return t, {k: c[k] for k in ("added", "modified", "deleted", "cached")}

    t, c = index()
    assert c == {"added": 3, "modified": 0, "deleted": 0, "cached": 0} and t.edges.count() == 3
    t, c = index()
    assert c == {"added": 1, "modified": 0, "deleted": 0, "cached": 2} and t.edges.count() == 3  # the file without parser again
    (root / "main.go").write_text("package main\n\nfunc main() {\n\tHelper()\n\tHelper()\n}\n\nfunc NewFunc() {}\n")
    t, c = index()
    assert c == {"added": 1, "modified": 1, "deleted": 0, "cached": 1} and t.symbols.count() == 3 and t.edges.count() == 5
    (root / "main.go").write_text("package main\n\nfunc main( {\n")  # cannot be parsed: the old entry stays
    assert index()[1]["modified"] == 1 and index()[0].symbols.count() == 3
    (root / "helper.go").unlink()
    t, c = index()
    assert c["deleted"] == 1 and t.edges.count() == 2
    assert index(force=True)[1]["added"] == 2
    (root / "helper.go").write_text("package main\n\n// Helper helps.\nfunc Helper() {}\n")
    assert cli.main(["--path", str(root), "--cache", cache, "context", "Helper", "--budget", "500"]) == 0
    assert "Symbol: `Helper`" in capsys.readouterr().out


def test_cache_and_index_tables(spark, tmp_path):
    path = str(tmp_path / "c")
    empty = store.load_cache(spark, path)
    assert empty.count() == 0
    (tmp_path / "broken" / "v-1").mkdir(parents=True)
    (tmp_path / "broken" / store.POINTER).write_text("v-1")
    assert store.load_cache(spark, str(tmp_path / "broken")).count() == 0
    (tmp_path / "broken" / "v-1" / "x.parquet").write_text("{")
    assert store.load_cache(spark, str(tmp_path / "broken")).count() == 0
    entry = spark.createDataFrame([("a.go", 1, 1, "x", [], ["imp"])], empty.schema)
    store.replace(store.put(empty, entry), path)
    store.replace(store.put(store.load_cache(spark, path), spark.createDataFrame([("a.go", 2, 1, "y", [], [])], empty.schema)), path)
    cache = store.load_cache(spark, path)
    assert store.get(cache, "a.go").first().checksum == "y" and cache.count() == 1
    assert store.remove(cache, cache.select("rel_path")).count() == 0
    store.replace(cache.limit(0), path)
    assert cache.count() == 1 and store.load_cache(spark, path).count() == 0  # a reader keeps its version
    store.replace(cache, path)
    assert len([p for p in (tmp_path / "c").iterdir() if p.name.startswith("v-")]) == 2
    nodes = N(spark, "file:a.go")
    store.save_index(nodes, E(spark, ("file:a.go", "node2"), ("zz", "file:a.go")), str(tmp_path / "i"))
    n, e = store.load_index(spark, str(tmp_path / "i"))
    assert n.count() == 1 and e.count() == 1
    assert store.current(spark, str(tmp_path / "i/metadata")).first().edges == 1


def test_bursts(spark, tmp_path):
    at = datetime(2024, 1, 1)
    ev = [("r", p, "write", at + timedelta(milliseconds=m)) for p, m in (("a.go", 0), ("b.go", 10), ("a.go", 20), (".git/x", 30), ("c.go", 500))]
    ev += [("r", None, "write", at), (None, "a", "write", at), ("q", "z.go", "write", at)]
    events = spark.createDataFrame(ev, FS_EVENTS)
    assert rows(watch.bursts(events, "100 milliseconds"), "repo_id", "events", "paths") == [("q", 1, ["z.go"]), ("r", 1, ["c.go"]), ("r", 3, ["a.go", "b.go"])]
    events.coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([("r", "late.go", "write", at + timedelta(hours=1))], FS_EVENTS).write.parquet(str(tmp_path / "in/2"))
    seen = []
    stream = spark.readStream.schema(FS_EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    watch.watch(stream, lambda b, i: seen.extend(map(tuple, b.select("repo_id", "events").collect())), str(tmp_path / "cp"), "100 milliseconds", once=True).awaitTermination()
    assert sorted(seen) == [("q", 1), ("r", 1), ("r", 3)]  # the last burst stays open


def test_watching_a_repository(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("def one(): pass\n")
    listing = str(tmp_path / "listing")
    assert watch.file_events(spark, str(root), listing).count() == 0
    (root / "a.py").write_text("def one(): pass\ndef two(): pass\n")
    (root / "b.py").write_text("def three(): pass\n")
    (root / ".hidden").write_text("x")
    assert rows(watch.file_events(spark, str(root), listing), "path", "op") == [("a.py", "write"), ("b.py", "write")]
    (root / "b.py").unlink()
    assert rows(watch.file_events(spark, str(root), listing), "path", "op") == [("b.py", "remove")]

    cache = str(tmp_path / "cache")
    live = pipeline.Live(spark, str(root), cache, pipeline.index(spark, str(root), cache)[0])
    renewed, stop = Event(), Event()

    def on_burst(burst, batch_id):
        live.renew(burst, batch_id)
        renewed.set()

    stream = watch.follow(spark, str(root), str(tmp_path / "w"), on_burst, stop, every=0.2)
    try:
        (root / "c.py").write_text("def four(): pass\n")
        assert renewed.wait(120)
    finally:
        stop.set()
        stream.stop()
    assert {r.name for r in live.symbols.select("name").collect()} == {"one", "two", "four"}


def test_tools_and_frames(spark):
    s = spark.createDataFrame(
        [("core/engine.go", 0, "ProcessData", "ProcessData", "function", "go", "func ProcessData()", "ProcessData works.", "{ }", True, 3, 1, 5, 2, [], []), ("api/handler.go", 0, "HandleRequest", "HandleRequest", "function", "go", "func HandleRequest()", "", "{}", True, 3, 1, 5, 2, ["core.ProcessData"], []), ("api/handler_test.go", 0, "TestHandleRequest", "TestHandleRequest", "function", "go", "func TestHandleRequest()", "", "{}", True, 3, 1, 5, 2, ["HandleRequest"], [])],
        "file_path string, ordinal int, name string, qualified_name string, kind string, language string, signature string, documentation string, body string, exported boolean, start_line int, start_col int, end_line int, end_col int, calls array<string>, implements array<string>",
    )
    files = s.select("file_path")
    imports = spark.createDataFrame([("api/handler.go", "core"), ("api/handler_test.go", "testing")], "file_path string, imp string")
    t = tools.Tools(resolve.build_nodes(s, files).cache(), resolve.build_edges(s, imports, files, single=True).cache(), s)
    assert "**Total Dependency Edges**: 6" in t.get_repo_map()

    def call(name, **arguments):
        return tools.answer(t, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})

    text_of = lambda r: r["result"]["content"][0]["text"]
    assert "ProcessData" in text_of(call("get_context_for_task", task_description="ProcessData", budget_tokens=900.7))
    assert "sym:api/handler.go::HandleRequest" in text_of(call("get_symbol_callers", symbol_name="ProcessData"))
    assert "ProcessData works." in text_of(call("get_symbol_definition", symbol_name="ProcessData", file_path="engine.go"))
    impact = text_of(call("get_impact_analysis", symbol_name="ProcessData"))
    assert "MEDIUM" in impact and "**Impacted Test Suites**: 1" in impact and "(hop 2)" in impact and "### Tests to run\n- `api/handler_test.go`" in impact
    assert call("get_impact_analysis", symbol_name="zz")["result"]["content"][0]["text"].endswith("not found.")
    assert "HandleRequest" in text_of(call("get_file_outline", file_path="handler.go"))
    assert "not found" in text_of(call("get_file_outline", file_path="none.go")) and "not found" in text_of(call("get_symbol_definition", symbol_name="q"))
    assert call("get_symbol_callers", symbol_name="  ")["error"]["code"] == -32602 and call("nothing")["error"]["code"] == -32601
    replies = list(tools.serve(t, ["", "{bad", json.dumps({"id": 1, "method": "initialize"}), json.dumps({"method": "notifications/initialized"}), json.dumps({"id": 2, "method": "tools/list"}), json.dumps({"id": 3, "method": "x"}), json.dumps({"id": 4, "method": "tools/call", "params": 5})]))
    parsed = [json.loads(r) for r in replies]
    assert parsed[0]["result"]["protocolVersion"] == "2024-11-05" and len(parsed[1]["result"]["tools"]) == 6
    assert parsed[2]["error"]["code"] == -32601 and parsed[3]["error"]["code"] == -32602
