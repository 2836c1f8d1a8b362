"""The numbered general operators on small and awkward inputs, against brute force."""

import random
from collections import Counter
from datetime import datetime

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweft.operators import hierarchy, hotkeys, imports, orphans, snapshots

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def T(d, h=0):
    return datetime(2024, 1, d, h)


# --- references without records


def brute_edges(edges, nodes, shared):
    out = set()
    for e, s, d, t in edges:
        for f, v in (("src", s), ("dst", d)):
            there = v in shared or any(i == v and a is not None and t is not None and a <= t and (r is None or t < r) for i, a, r in nodes)
            if v is not None and not there:
                out.add(("edges", e, f, v, t and t.strftime("%Y-%m")))
    return sorted(out, key=repr)


def _edge_case(spark, edges, nodes, shared):
    e = spark.createDataFrame(edges, "edge_id long, src string, dst string, recorded_at timestamp").selectExpr("*", "1 as key", "2 as h", "'x' as type")
    n = spark.createDataFrame(nodes, "id string, added_at timestamp, removed_at timestamp")
    return orphans.edge_orphans(e, n, spark.createDataFrame([(s,) for s in shared], "id string"))


def test_edge_orphans_by_time(spark):
    nodes = [("a", T(1), T(3)), ("a", T(5), None), ("a", T(5), None), ("b", T(2), None), ("n", None, None), (None, T(1), None)]
    edges = [(i, x, y, t) for i, (x, y, t) in enumerate([("a", "b", T(2)), ("a", "b", T(3)), ("a", "b", T(4)), ("b", "a", T(5)), ("zz", None, T(6)), ("n", "s", T(6)), ("", "s", T(6)), ("a", "s", None)])]
    edges += [edges[1], edges[1]]
    assert rows(_edge_case(spark, edges, nodes, ["s"])) == brute_edges(edges, nodes, {"s"})


def test_edge_orphans_random_and_split(spark, monkeypatch):
    rnd = random.Random(4)
    ids = [f"id{i}" for i in range(30)]
    nodes = [(rnd.choice([*ids, "hot"]), T(rnd.randint(1, 9)), rnd.choice([None, T(rnd.randint(10, 20))])) for _ in range(60)]
    nodes += [("hot", T(d, h), T(d, h + 3)) for d in range(10, 24, 2) for h in range(9)]
    edges = [(i, rnd.choice([*ids, "hot", "hot", "hot"]), "hot" if i % 3 else rnd.choice(ids), T(rnd.randint(1, 25))) for i in range(600)]
    monkeypatch.setattr(orphans, "probe", lambda *a, f=orphans.probe: f(*a, range_rows=200, split_rows=7))  # hot ranges in pieces, on both sides
    assert rows(_edge_case(spark, edges, nodes, ["id3"])) == brute_edges(edges, nodes, {"id3"})


def test_orphans_of_empty_tables(spark):
    assert rows(_edge_case(spark, [], [], [])) == []
    assert rows(_edge_case(spark, [(1, "a", None, T(1))], [], [])) == [("edges", 1, "src", "a", "2024-01")]


def test_call_and_import_orphans(spark):
    sym = "symbol_id long, file_path string, name string, qualified_name string, calls array<string>, imports array<string>, parsed_at timestamp"
    data = [
        (1, "r/a/x.py", "f", "C.f", ["g", "o.g", "C.f", "q.", "lost", None, "lib", "m.lib", "D.h"], ["./b", "c", "org.b", "lib_i", "a", None, "./"], T(2)),
        (2, "r/b/y.py", "g", "D.h", None, ["x.py", "y.py"], T(2)),
        (3, "s/z.py", "lost", None, ["g"], ["./"], None),
        (4, None, "n", "n", ["n", "zz"], [], T(3)),
    ]
    symbols = spark.createDataFrame(data + data[:1], sym)
    shared = spark.createDataFrame([("lib", None), (None, "lib_i")], "name string, import_name string")
    files = spark.createDataFrame([("r/a/x.py",), ("r/b/y.py",), ("r/b/y.py",), ("s/z.py",), (None,)], "rel_path string")
    calls = rows(orphans.call_orphans(symbols, shared), "ref_id", "ref_value")
    assert calls == sorted([(1, "q."), (1, "lost"), (1, "D.h"), (3, "g"), (4, "zz")], key=repr)
    # 'y.py' and './' match no file but the importing one; 'a' is the importing file's own directory
    got = rows(orphans.import_orphans(symbols, files, shared), "ref_id", "ref_value")
    assert got == sorted([(1, "c"), (1, "a"), (2, "y.py"), (3, "./")], key=repr)


@FEW
@given(st.lists(st.text("ab./", min_size=1, max_size=7), min_size=1, max_size=8), st.lists(st.text("ab./", max_size=4), max_size=8))
def test_import_matches_like_brute_force(spark, paths, texts):
    paths, texts = sorted({f"r/{p}" for p in paths}), sorted(set(texts))
    base = lambda p: p.rsplit("/", 2)[-2]
    brute = sorted(("r", t, p) for t in texts for p in paths if p.endswith(t) or t.removeprefix("./") in p or (base(p) or "/") and t.endswith(base(p) or "/"))
    asked = spark.createDataFrame([("r", t) for t in texts] + [("r", None), (None, "a")], "repo string, text string")
    held = spark.createDataFrame([("r", p) for p in paths] + [("r", None), ("empty", "a/b")], "repo string, path string")
    for block in (4096, 2):  # also where a repository has several blocks
        assert rows(imports.matches(asked, held, block_paths=block), "repo", "text", "path") == brute
    assert {r[:2] for r in rows(imports.matches(asked, held, 1, 2))} == {r[:2] for r in brute}


def test_imports_go_only_to_blocks_that_may_match(spark):
    paths = [(r, f"{r}/pkg{i % 40}/deep/file_number_{i}.go") for r in ("r", "q") for i in range(400)]
    texts = [("r", f"github.com/x/pkg{i}") for i in range(40)] + [("r", f"file_number_{i}.go") for i in range(0, 400, 7)] + [("r", "nowhere/at/all"), ("r", "deep"), ("q", "./")]
    held = spark.createDataFrame(paths, "repo string, path string").withColumn("block", F.pmod(F.xxhash64("path"), F.lit(20)).cast("int"))
    sent = rows(imports._where_to(spark.createDataFrame(texts, "repo string, text string"), held))
    per = Counter((r, t) for r, _, t in sent)
    assert per["r", "deep"] == 20 == per["q", "./"] and not per["r", "nowhere/at/all"] and len(sent) == len(set(sent))
    assert all(per["r", f"file_number_{i}.go"] in (1, 2, 3) for i in range(0, 400, 7))


# --- hierarchies


def brute_tree(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    out = []
    for v in sorted({*up, *up.values()}):
        way = [v]
        while way[-1] in up and up[way[-1]] not in way:
            way.append(up[way[-1]])
        if way[-1] in up:
            ring = way[way.index(up[way[-1]]) :]
            out.append((v, min(ring), -1))
        else:
            out.append((v, way[-1], len(way) - 1))
    return out


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(None, "a"), ("a", None)],
        [("a", "a")],
        [("b", "a"), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "w")],
        [(f"n{i:03}", f"n{i - 1:03}") for i in range(1, 40)],
        [(f"k{i:03}", "hub") for i in range(150)] + [("hub", "top"), ("k003", "other")],
    ],
)
def test_hierarchy(spark, links):
    df = spark.createDataFrame(links, "child string, parent string")
    got = hierarchy.hierarchy(df).cache()
    assert rows(got, "node_id", "root_id", "depth") == brute_tree(links)
    spans = {r.node_id: (r.root_id, r.tour_start, r.tour_end, r.descendants) for r in got.collect() if r.depth >= 0}
    below = rows(hierarchy.descendants(df), "node_id", "descendant_id")
    inside = sorted((u, v) for u, (r, a, b, _) in spans.items() for v, (s, x, _, _) in spans.items() if r == s and a < x < b)
    assert below == inside
    assert {u: n for u, (_, _, _, n) in spans.items()} == {u: Counter(a for a, _ in inside)[u] for u in spans}


@FEW
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=16))
def test_hierarchy_random(spark, pairs):
    links = [(f"n{a:02}", f"n{b:02}") for a, b in pairs]
    assert rows(hierarchy.hierarchy(spark.createDataFrame(links, "child string, parent string")), "node_id", "root_id", "depth") == brute_tree(links)


def test_paths_in_small_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    links = [(f"n{i:03}", f"n{rnd.randrange(max(0, i - 9), i):03}") for i in range(1, 150)] + [(f"k{i}", "hub") for i in range(60)] + [("a", "b"), ("b", "a")]
    up = dict(links)

    def way(v):
        return [*way(up[v]), v] if v in up else [v]

    monkeypatch.setattr(hierarchy, "TOUR_BLOCK", 8)
    monkeypatch.setattr(hierarchy, "PATH_IDS", 20)
    df = spark.createDataFrame(links, "child string, parent string")
    assert rows(hierarchy.paths(df)) == sorted(((v, way(v)) for v in {*up, *up.values()} - {"a", "b"}), key=repr)
    got = {r.node_id: (r.depth, r.path) for r in hierarchy.hierarchy_with_paths(df).collect()}
    assert got["a"] == (-1, None) and got["hub"] == (0, ["hub"]) and all(p is None or len(p) == d + 1 for d, p in got.values())


def test_paths(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("z", "z")], "child string, parent string")
    assert rows(hierarchy.paths(df)) == [("a", ["a"]), ("b", ["a", "b"]), ("c", ["a", "b", "c"]), ("d", ["a", "b", "c", "d"])]


# --- keys that hold most rows


def test_key_totals(spark, monkeypatch):
    data = [("hot", 1.0)] * 500 + [(f"k{i % 40}", 0.5) for i in range(200)] + [(None, 2.0), ("", None), ("x" * 50_000, float("nan"))]
    df = spark.createDataFrame(data, "k string, w double").repartition(5).withColumnRenamed("w", "n")  # a clashing column
    monkeypatch.setattr(hotkeys, "FLUSH_KEYS", 3)
    got = {r.key: (r.n, r.w) for r in hotkeys.key_totals(df, "k", {"w": df.n}).collect()}
    count, total = Counter(k for k, _ in data), Counter()
    for k, w in data:
        total[k] += w if w and w == w else 0
    assert got == {k: (count[k], total[k]) for k in count}
    assert hotkeys.key_totals(df.limit(0), "k").count() == 0


def test_key_totals_in_small_batches(spark, monkeypatch):
    df = spark.range(5000).selectExpr("concat('k', id % 700) as k").repartition(6)
    monkeypatch.setattr(hotkeys, "FLUSH_KEYS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = hotkeys.key_totals(df, "k").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 700 and {r.key: r.n for r in got} == Counter(f"k{i % 700}" for i in range(5000))


def test_hot_keys(spark):
    totals = hotkeys.key_totals(spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 96, "k string"), "k").cache()
    assert rows(hotkeys.hot_keys(totals, 0.02), "key") == [("a",)]
    assert rows(hotkeys.hot_keys(totals.limit(0)), "key") == []


# --- changes between snapshots


def test_file_changes(spark):
    c = "snapshot_no int, rel_path string, checksum string, loaded_at timestamp, key string"
    data = [
        (1, "r/a", "AB", T(1)), (1, "./r\\b", "1", T(1)), (1, "r/c", "1", T(1)), (1, "r/c", "2", T(2)), (1, "q/only", "1", T(1)),
        (3, "r/a", "ab", T(3)), (3, "r/c", "1", T(3)), (3, "r//d", None, T(3)), (3, "r/d", None, T(3)),
        (4, "r/a", "ac", T(4)), (4, "r/d", "5", T(4)), (5, None, "5", T(4)), (None, "r/a", "5", T(4)),
    ]
    df = spark.createDataFrame([(*d, "x") for d in data], c)
    assert rows(snapshots.file_changes(df), "snapshot_no", "key", "change") == [
        (3, "r/b", "removed"), (3, "r/c", "modified"), (3, "r/d", "added"), (4, "r/a", "modified"), (4, "r/c", "removed"), (4, "r/d", "modified"),
    ]
    assert snapshots.file_changes(df.limit(0)).count() == 0

def test_file_changes_with_many_deliveries(spark, monkeypatch):
    """Groups with gaps, one of them large, against brute force; beyond the bound nothing that grows with the deliveries is broadcast."""
    monkeypatch.setattr(snapshots, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(snapshots, "PIECE_ROWS", 20)
    rand = random.Random(3)
    data = [(s, f"g{g}/f{k}", str(rand.randrange(2)), T(1)) for g in range(6) for s in (1, 2, 3, 5, 9, -(2**31), 2**31 - 1) if rand.random() < 0.8 for k in range(150 if g == 1 else 8) if rand.random() < 0.7]
    df = spark.createDataFrame(data, "snapshot_no int, rel_path string, checksum string, loaded_at timestamp")
    held = {}
    for s, p, c, _ in data:
        held.setdefault(p.split("/")[0], {}).setdefault(s, {})[p] = c
    want = []
    for per in held.values():
        for a, b in zip(sorted(per), sorted(per)[1:]):
            want += [(b, p, "added" if p not in per[a] else "removed" if p not in per[b] else "modified") for p in per[a].keys() | per[b].keys() if per[a].get(p) != per[b].get(p)]
    got = snapshots.file_changes(df)
    assert rows(got, "snapshot_no", "key", "change") == sorted(want, key=repr)
    assert rows(snapshots.file_changes(df.withColumn("snapshot_no", F.col("snapshot_no").cast("double"))).select(F.col("snapshot_no").cast("int"), "key", "change")) == sorted(want, key=repr)

    table, n = snapshots.deliveries(df.select(F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("grp"), "snapshot_no"))
    assert n > 30 and 0 < table.where("pieces > 1").count() < 8 and table.where("pieces > 1 and grp <> 'g1'").count() == 0
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1 and "LeftOuter" in plan
