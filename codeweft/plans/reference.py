"""Queries on the engine's own operators, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, incremental, pack, pagerank, ranking, resolve, search, snapshots
from ..parsers import golang, lines, registry
from ..schemas import SYMBOLS
from ..session import Scratch, load
from ..streaming import watch

#: Names and texts that the queries ask for.
NAME, TASK, STARTS, OUTLINE = "handle", "Fix the CursorQueue snapshot handler in schema budget", "main", "/schema.py"


def nodes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that are there now, each once, and those of the shared library."""
    now = load(spark, sf_dir, "nodes").where("removed_at is null and id is not null")
    now = now.groupBy("id").agg(F.max_by(F.struct("type", "file_path", "symbol"), "added_at").alias("m")).select("id", "m.*")
    fields = now.schema["symbol"].dataType
    shared = load(spark, sf_dir, "shared_nodes").select(
        "id", "type", "file_path", F.when(F.col("name").isNotNull(), F.struct(*[(F.col("name") if f.name in ("name", "qualified_name") else F.lit(None).cast("string")).alias(f.name) for f in fields])).alias("symbol")
    )
    return now.unionByName(shared)


def edges_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with both ends, each row once by its id; types in upper case, a missing or zero weight is 1."""
    e = load(spark, sf_dir, "edges").where("src is not null and dst is not null").dropDuplicates(["edge_id"])
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return e.select("src", "dst", F.upper(F.trim("type")).alias("type"), weight.alias("weight"))


def symbols_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed symbols, each row once by its id."""
    return load(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"]).withColumn("kind", F.lower(F.trim("kind")))


def files_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "source_files").where("rel_path is not null").select(F.col("rel_path").alias("file_path"), "content")


def imports_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imports of each file, as its first symbol that has them tells."""
    s = load(spark, sf_dir, "symbols").where("imports is not null").groupBy("file_path").agg(F.min_by("imports", "symbol_id").alias("imports"))
    return s.select("file_path", F.explode("imports").alias("imp"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nodes_view(spark, sf_dir), edges_view(spark, sf_dir)


def graph_summary(spark, sf_dir):
    return graph.summary(*_graph(spark, sf_dir))


def language_histogram(spark, sf_dir):
    return graph.histogram(nodes_view(spark, sf_dir), "language")


def kind_histogram(spark, sf_dir):
    return graph.histogram(nodes_view(spark, sf_dir), "kind")


def symbol_lookup(spark, sf_dir):
    return graph.lookup(nodes_view(spark, sf_dir), NAME).select("id", "file_path", F.col("symbol.qualified_name").alias("qualified_name"))


def symbol_callers(spark, sf_dir):
    return graph.callers(*_graph(spark, sf_dir), NAME)


def file_outline(spark, sf_dir):
    return graph.outline(nodes_view(spark, sf_dir), OUTLINE).select("id", "file_path", F.col("symbol.name").alias("name"), F.col("symbol.kind").alias("kind"))


def _khop(direction: str, types: list[str] = ()):
    def query(spark, sf_dir):
        nodes, edges = _graph(spark, sf_dir)
        starts = graph.lookup(nodes, STARTS).select(F.col("id").alias("start"))
        return graph.khop(nodes, edges, starts, 2, direction, types)

    return query


def impact_callers(spark, sf_dir):
    return graph.impact_callers(*_graph(spark, sf_dir), NAME)


def impact_summary(spark, sf_dir):
    return graph.impact_summary(*_graph(spark, sf_dir), NAME)


def remove_test_files(spark, sf_dir):
    """Edges left, by type, after the nodes of test files are gone."""
    nodes, edges = _graph(spark, sf_dir)
    gone = nodes.where(text.is_test_file(F.col("file_path"))).select("file_path")
    return graph.remove_files(nodes, edges, gone)[1].groupBy("type").agg(F.count(F.lit(1)).alias("edges"))


def _ppr(iterations: int, seeded: bool):
    def query(spark, sf_dir):
        nodes, edges = _graph(spark, sf_dir)
        seeds = graph.lookup(nodes, NAME).select("id", F.lit(1.0).alias("weight")) if seeded else nodes.select("id", F.lit(0.0).alias("weight"))
        return pagerank.pagerank(nodes, edges, seeds, iterations=iterations).select("id", F.round("score", 9).alias("score"))

    return query


def query_tokens(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokenize_query(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


def token_estimates(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def built_nodes(spark, sf_dir):
    n = resolve.build_nodes(symbols_view(spark, sf_dir), files_view(spark, sf_dir))
    return n.select("id", "type", "file_path", F.col("symbol.signature").alias("signature"), "token_cost", "skel_cost")


def search_scores(spark, sf_dir):
    return search.score(resolve.build_nodes(symbols_view(spark, sf_dir), files_view(spark, sf_dir)), TASK)


def context_pack(spark, sf_dir):
    """The items for TASK: search, PageRank, packing."""
    s = Scratch(spark, "context")
    nodes = s.cut(resolve.build_nodes(symbols_view(spark, sf_dir), files_view(spark, sf_dir)))
    edges = s.cut(edges_view(spark, sf_dir))
    ranked = pagerank.pagerank(nodes, edges, search.seeds(nodes, TASK))
    return pack.select(nodes, edges, ranked)[0].withColumn("relevance", F.round("relevance", 9))


def pagerank_ranked(spark, sf_dir):
    """Nodes in the order of their scores (compared to 9 places), then ids."""
    return ranking.ranked(_ppr(5, True)(spark, sf_dir), [F.desc("score"), F.asc("id")])


def search_ranked(spark, sf_dir):
    """Matches of TASK in the order of their scores, then ids."""
    return ranking.ranked(search_scores(spark, sf_dir).select("id", "score"), [F.desc("score"), F.asc("id")])


def symbol_definition(spark, sf_dir):
    """The last row of each symbol of that name or qualified name, as its definition is shown."""
    s = symbols_view(spark, sf_dir).where((F.col("name") == NAME) | (F.col("qualified_name") == NAME))
    shown = ["kind", "language", "exported", "signature", "documentation", "body", "start_line", "end_line"]
    calls = F.array_join(F.coalesce("calls", F.array().cast("array<string>")), "|").alias("calls")
    last = s.groupBy("file_path", "name").agg(F.max_by(F.struct(*shown, calls), F.struct("ordinal", "symbol_id")).alias("m"))
    return last.select("file_path", "name", "m.*")


def impact_tests(spark, sf_dir):
    """The test files to run after a change of each symbol of that name."""
    return graph.impact_tests(*_graph(spark, sf_dir), NAME)


def _last_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scanned path once, as scanned last, with size and checksum of its content."""
    f = load(spark, sf_dir, "source_files").where("rel_path is not null")
    f = f.select("rel_path", "content", F.octet_length("content").cast("bigint").alias("size"), "mtime_ns", text.checksum(F.col("content")).alias("checksum"))
    small = f.groupBy("rel_path").agg(F.max("mtime_ns").alias("mtime_ns"))
    return f.join(small, ["rel_path", "mtime_ns"], "left_semi").dropDuplicates(["rel_path"])


def _last_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each repository's last delivery, as a file cache."""
    path = snapshots.canonical_path(F.col("rel_path"))
    c = load(spark, sf_dir, "file_cache").withColumn("rel_path", path).withColumn("grp", resolve.repository(path))
    c = c.groupBy("grp", "snapshot_no", "rel_path").agg(F.max_by(F.struct(F.lower("checksum").alias("checksum"), "size", "mtime_ns", "symbols", "imports"), "loaded_at").alias("m")).select("grp", "snapshot_no", "rel_path", "m.*")
    c = snapshots.placed(c, "rel_path", snapshots.deliveries(c.select("grp", "snapshot_no"))).where("next_no is null")
    fields = [f.split(" ") for f in SYMBOLS.split(", ")]
    known = {"name": lambda x: x["name"], "kind": lambda x: x["kind"]}
    entry = lambda p: lambda x, i: F.struct(*[(p if f == "file_path" else i if f == "ordinal" else known[f](x) if f in known else F.lit(None)).cast(t).alias(f) for f, t in fields])
    none = F.array().cast("array<string>")
    return c.select("rel_path", "size", "mtime_ns", "checksum", F.transform("symbols", entry(F.col("rel_path"))).alias("symbols"), F.coalesce("imports", none).alias("imports"))


def reindex_status(spark, sf_dir):
    """What a pass over the last scan finds against the last deliveries, and whether a parser takes the file."""
    files, cache = _last_scan(spark, sf_dir).drop("content"), _last_cache(spark, sf_dir)
    found = incremental.classify(files, cache)
    return found.withColumn("supported", text.extension(F.col("rel_path")).isin(registry.extensions()))


def reindex_cache(spark, sf_dir):
    """The cache after that pass: only added and modified files are parsed, failed ones keep their old entry."""
    new = incremental.reindex(_last_scan(spark, sf_dir), _last_cache(spark, sf_dir))[3]
    return new.select("rel_path", "size", "checksum", F.size("symbols").alias("symbols"), F.size("imports").alias("imports"))


def reindex_edges(spark, sf_dir):
    """Edges of the graph rebuilt from that cache, by type."""
    s = Scratch(spark, "reindex")
    _, symbols, imports, new = incremental.reindex(_last_scan(spark, sf_dir), _last_cache(spark, sf_dir))
    symbols, imports = s.cut(symbols), s.cut(imports)
    edges = resolve.build_edges(symbols, imports.select("file_path", "imp"), new.select(F.col("rel_path").alias("file_path")))
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


def skeletons(spark, sf_dir):
    """Costs of each symbol's skeleton and whole text."""
    s = symbols_view(spark, sf_dir)
    full = F.when(F.coalesce("body", F.lit("")) != "", text.token_estimate(text.full_text(F.col("documentation"), F.col("signature"), F.col("body"))))
    return s.select("symbol_id", text.token_estimate(text.skeleton(F.col("documentation"), F.col("signature"))).alias("skel"), full.alias("full_cost"))


def defines_edges(spark, sf_dir):
    return resolve.defines_edges(symbols_view(spark, sf_dir))


def import_edges(spark, sf_dir):
    return resolve.import_edges(imports_view(spark, sf_dir), files_view(spark, sf_dir))


def call_edges(spark, sf_dir):
    return resolve.call_edges(symbols_view(spark, sf_dir))


def implements_edges(spark, sf_dir):
    return resolve.implements_edges(symbols_view(spark, sf_dir))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = snapshots.canonical_path(F.col("rel_path"))
    c = load(spark, sf_dir, "file_cache").withColumn("rel_path", path).withColumn("grp", resolve.repository(path))
    last = F.max(F.struct("loaded_at", F.lower("checksum").alias("checksum"), "size", "mtime_ns")).alias("m")
    return c.groupBy("grp", "snapshot_no", "rel_path").agg(last).select("grp", "snapshot_no", "rel_path", "m.checksum", "m.size", "m.mtime_ns")


def incremental_classify(spark, sf_dir):
    """Each delivery's files against the entries of the repository's delivery before; its first is all added."""
    d = _deliveries(spark, sf_dir)
    near = snapshots.placed(d, "rel_path", snapshots.deliveries(d.select("grp", "snapshot_no")))
    cache = near.where("next_no is not null").withColumn("snapshot_no", F.col("next_no"))
    return incremental.classify(near, cache, ["snapshot_no", "rel_path"])


def incremental_stats(spark, sf_dir):
    return incremental.stats(incremental_classify(spark, sf_dir))


def watch_bursts(spark, sf_dir):
    """Bursts of each user's events, ended by a quiet hour."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo_id"), F.col("event_type").alias("path"), F.lit("write").alias("op"), "ts")
    return watch.bursts(e, "60 minutes").withColumn("paths", F.array_join("paths", ","))


def path_rules(spark, sf_dir):
    """Ignored or not, language, fence and test of each scanned file."""
    f = load(spark, sf_dir, "source_files").where("rel_path is not null").select("rel_path", "size").distinct()
    p = F.col("rel_path")
    return f.select("rel_path", "size", text.is_ignored(p, F.col("size")).alias("ignored"), text.detect_language(p).alias("language"), text.fence(p).alias("fence"), text.is_test_file(p).alias("is_test"), text.directory_name(p).alias("directory"))


def checksums(spark, sf_dir):
    return load(spark, sf_dir, "source_files").select("rel_path", text.checksum(F.col("content")).alias("checksum")).distinct()


def symbol_locations(spark, sf_dir):
    c = [F.col(x) for x in ("start_line", "start_col", "end_line", "end_col")]
    return symbols_view(spark, sf_dir).select("symbol_id", text.location(F.col("file_path"), *c).alias("location"), text.location_valid(c[0], c[2]).alias("valid"))


def _parsed(parser, *extensions: str):
    def query(spark, sf_dir):
        files = files_view(spark, sf_dir).where(text.extension(F.col("file_path")).isin(*extensions))
        s = parser(files)[0]
        return s.withColumns({c: F.array_join(c, "|") for c in ("calls", "implements")}).drop("start_col", "end_col")

    return query


def _imported(parser, *extensions: str):
    return lambda spark, sf_dir: parser(files_view(spark, sf_dir).where(text.extension(F.col("file_path")).isin(*extensions)))[1]


QUERIES = {
    f.__name__: f
    for f in (graph_summary, language_histogram, kind_histogram, symbol_lookup, symbol_callers, file_outline, impact_callers, impact_summary, remove_test_files, query_tokens, token_estimates, built_nodes, search_scores, context_pack, pagerank_ranked, search_ranked, symbol_definition, impact_tests, reindex_status, reindex_cache, reindex_edges, skeletons, defines_edges, import_edges, call_edges, implements_edges, incremental_classify, incremental_stats, watch_bursts, path_rules, checksums, symbol_locations)
}
QUERIES |= {"khop_out": _khop("outgoing"), "khop_in": _khop("incoming"), "khop_both": _khop("both", ["DEFINES"])}
QUERIES |= {"pagerank_5": _ppr(5, True), "pagerank_uniform_3": _ppr(3, False), "pagerank": _ppr(25, True)}
_LANGUAGES = {"python": (lines.python, "py"), "typescript": (lines.typescript, "ts", "tsx", "js", "jsx", "mjs", "cjs"), "java": (lines.java, "java"), "php": (lines.php, "php"), "rust": (lines.rust, "rs"), "go": (golang.golang, "go")}
QUERIES |= {f"parse_{k}": _parsed(*v) for k, v in _LANGUAGES.items()} | {f"imports_{k}": _imported(*v) for k, v in _LANGUAGES.items()}
