"""The property graph as two DataFrames: nodes (id, type, file_path, symbol, ...) and a bag of edges (src, dst, type, weight).

Rows of nodes whose symbol is null are files. Edges may recur and may lead to missing nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import Scratch, small

#: Edge types that make a caller, fixed values.
CALLER_TYPES = ["CALLS", "REFERENCES"]


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: file nodes, other nodes, and edges that leave existing nodes (their targets may be missing)."""
    none = F.lit(0).cast("bigint")
    n = nodes.select(F.col("type").eqNullSafe("file").cast("bigint").alias("f"), (~F.col("type").eqNullSafe("file")).cast("bigint").alias("s"), none.alias("e"))
    left = edges.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    every = n.unionByName(left.select(none.alias("f"), none.alias("s"), F.lit(1).cast("bigint").alias("e")))
    return every.agg(*[F.coalesce(F.sum(c), none).alias(k) for c, k in (("f", "total_files"), ("s", "total_symbols"), ("e", "total_edges"))])


def histogram(nodes: DataFrame, field: str) -> DataFrame:
    """Symbols by a field of the symbol ('language', 'kind'); null is a value of its own."""
    return nodes.where("symbol is not null").groupBy(F.col(f"symbol.{field}").alias(field)).agg(F.count(F.lit(1)).alias("symbols"))


def lookup(nodes: DataFrame, name: str, path_suffix: str = "") -> DataFrame:
    """Symbol nodes with this name or qualified name, in files whose path ends so."""
    hit = nodes.where((F.col("symbol.name") == name) | (F.col("symbol.qualified_name") == name))
    return hit.where(F.endswith("file_path", F.lit(path_suffix))) if path_suffix else hit


def callers(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node_id, file_path, caller, edge_type): each calling edge into each symbol of that name, repeated ones too.

    A symbol without callers has one row with null caller.
    """
    hit = lookup(nodes, name).select(F.col("id").alias("node_id"), "file_path")
    into = edges.where(F.col("type").isin(CALLER_TYPES)).select(F.col("dst").alias("node_id"), F.col("src").alias("caller"), F.col("type").alias("edge_type"))
    return hit.join(into, "node_id", "left")


def outline(nodes: DataFrame, path_suffix: str) -> DataFrame:
    """Symbol nodes of the files whose path ends so; several files are merged."""
    return nodes.where(F.endswith("file_path", F.lit(path_suffix)) & F.col("symbol").isNotNull())


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of gone (id) and all their edges."""
    ids = gone.select("id").where("id is not null").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(edges.columns)


def remove_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of the files in paths (file_path)."""
    return remove_nodes(nodes, edges, nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id"))


def _steps(edges: DataFrame, direction: str, types: list[str]) -> DataFrame:
    """(a, b): a step from a to b, each once."""
    e = edges.where("src is not null and dst is not null")
    e = e.where(F.col("type").isin(types)) if types else e
    out, into = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    ways = {"": out, "outgoing": out, "incoming": into, "both": out.unionByName(into)}
    return ways.get(direction, out.where("false")).distinct()


def _spread(starts: DataFrame, steps: DataFrame, hops: int, s: Scratch, known: DataFrame | None) -> DataFrame:
    """(start, node_id, hop): least hops from each start, itself left out. Nodes that are not in `known`
    are seen but not gone on from (None: all are). A front of few rows is broadcast, so that the steps are not shuffled."""
    front, n = s.cut_counting(starts.select(F.col("start"), F.col("start").alias("node_id"), F.lit(0).alias("hop")).distinct())
    seen = front
    for hop in range(1, hops + 1):
        go = small(front, n["rows"])
        go = go.join(known, "node_id", "left_semi") if known is not None and hop > 1 else go
        go = small(go, n["rows"])
        nxt = go.join(steps, go.node_id == steps.a).select("start", F.col("b").alias("node_id")).distinct()
        nxt = nxt.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").withColumn("hop", F.lit(hop))
        front, n = s.cut_counting(nxt)
        if not n["rows"]:
            break
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def khop(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 1, direction: str = "outgoing", types: list[str] = ()) -> DataFrame:
    """(start, node_id, hop) of the nodes within `hops` of each start (column start), by the least number.

    hops below 1 count as 1; '' is outgoing, an unknown direction has no edges, no types means all.
    The start itself is left out, missing nodes are neither given nor gone on from.
    """
    s = Scratch(nodes.sparkSession, "khop")
    ids = s.cut(nodes.select(F.col("id").alias("node_id")).distinct())
    found = _spread(starts.where("start is not null"), s.cut(_steps(edges, direction, list(types))), max(1, hops), s, ids)
    return found.join(ids, "node_id", "left_semi").select("start", "node_id", "hop")


def impact_callers(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """(target, caller, hop, file_path): who is affected by each symbol of that name, up `depth` calling edges.

    A caller without a node is given and gone on from, with null file_path. depth below 1 counts as 3.
    """
    s = Scratch(nodes.sparkSession, "impact")
    targets = lookup(nodes, name).select(F.col("id").alias("start"))
    found = _spread(targets, s.cut(_steps(edges, "incoming", CALLER_TYPES)), depth if depth > 0 else 3, s, None)
    place = nodes.select(F.col("id").alias("node_id"), "file_path").distinct()
    return found.join(place, "node_id", "left").select(F.col("start").alias("target"), F.col("node_id").alias("caller"), "hop", "file_path")


def impact_counts(nodes: DataFrame, affected: DataFrame, name: str) -> DataFrame:
    """One row for each symbol of that name: its affected callers in all, direct, transitive, their files and test files, and the risk.

    Callers without a node count in all only.
    """
    known = F.col("file_path").isNotNull()
    per = affected.groupBy("target").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(known & (F.col("hop") == 1)).alias("direct"),
        F.count_if(known & (F.col("hop") > 1)).alias("transitive"),
        F.countDistinct("file_path").alias("files"),
        F.countDistinct(F.when(text.is_test_file(F.col("file_path")), F.col("file_path"))).alias("test_files"),
    )
    counts = ["total", "direct", "transitive", "files", "test_files"]
    targets = lookup(nodes, name).select(F.col("id").alias("target"), F.col("file_path").alias("defined_in")).distinct()
    per = targets.join(per, "target", "left").fillna(0, counts)
    return per.withColumn("risk", text.risk(F.col("total")))


def impact_summary(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """impact_counts of the callers up to `depth` calling edges away."""
    return impact_counts(nodes, impact_callers(nodes, edges, name, depth), name)


def impact_tests(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """(target, test_file, hop) of the test files with affected callers, at the least hops: the tests to run after a change."""
    c = impact_callers(nodes, edges, name, depth).where(text.is_test_file(F.col("file_path")))
    return c.groupBy("target", F.col("file_path").alias("test_file")).agg(F.min("hop").alias("hop"))
