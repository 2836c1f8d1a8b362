"""Indexing of a repository: scan, incremental parse, graph, cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import incremental, resolve
from .session import Scratch
from .sources import repository, store
from .tools import Tools


def index(spark: SparkSession, root: str, cache_path: str, force: bool = False) -> tuple[Tools, dict]:
    """The tools over the indexed repository, and the pass's counters. The cache is replaced at the end."""
    s = Scratch(spark, "index")
    files = s.cut(repository.scan(spark, root))
    cache = store.load_cache(spark, cache_path)
    cache = cache.limit(0) if force else cache
    classified, _, _, new = incremental.reindex(files, cache)
    counters = incremental.stats(classified).first().asDict()
    store.replace(new, cache_path)
    return tools_of(store.load_cache(spark, cache_path), s), counters


def tools_of(cache: DataFrame, s: Scratch) -> Tools:
    """The tools over the graph of cached entries."""
    symbols = s.cut(cache.select(F.inline("symbols")))
    imports = cache.select(F.col("rel_path").alias("file_path"), F.explode("imports").alias("imp"))
    paths = cache.select(F.col("rel_path").alias("file_path"))
    nodes = s.cut(resolve.build_nodes(symbols, paths))
    edges = s.cut(resolve.build_edges(symbols, imports, paths, single=True))
    return Tools(nodes, edges, symbols)


class Live:
    """The tools over the newest index: a tool that runs keeps the index it began with."""

    def __init__(self, spark: SparkSession, root: str, cache_path: str, tools: Tools):
        self.spark, self.root, self.cache_path, self.tools = spark, root, cache_path, tools

    def renew(self, bursts: DataFrame, batch_id: int) -> None:
        self.tools, _ = index(self.spark, self.root, self.cache_path)

    def __getattr__(self, name: str):
        return getattr(self.tools, name)
