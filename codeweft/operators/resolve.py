"""Symbols and imports to the graph: nodes, and DEFINES, IMPORTS, CALLS and IMPLEMENTS edges as a bag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import imports as import_paths

#: Weights of edges, fixed values.
DEFINES, IMPORTS, LOCAL_CALL, GLOBAL_CALL, IMPLEMENTS = 1.0, 1.0, 2.0, 1.0, 1.5


def _edge(df: DataFrame, type_: str, weight: float) -> DataFrame:
    return df.select("src", "dst", F.lit(type_).alias("type"), F.lit(weight).alias("weight"))


def repository(path: Column, single: bool = False) -> Column:
    """The repository of a path: its first segment, or the same for all paths."""
    return F.lit("") if single else F.split_part(F.coalesce(path, F.lit("")), F.lit("/"), F.lit(1))


def build_nodes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A file node for each path of files (file_path), and one symbol node for each path and name, of the last symbol by ordinal.

    Costs are a fourth of the bytes of body and signature.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = ["name", "qualified_name", "kind", "language", "signature", "documentation", "body"]
    cost = lambda c: (F.octet_length(part(c)) / 4).cast("int")
    s = symbols.where("file_path is not null and name is not null").select("file_path", "name", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.struct(*fields).alias("symbol"), cost("body").alias("token_cost"), cost("signature").alias("skel_cost"))
    s = s.groupBy("file_path", "name").agg(F.max_by(F.struct("symbol", "token_cost", "skel_cost"), "ordinal").alias("m"))
    s = s.select(text.symbol_id(F.col("file_path"), F.col("name")).alias("id"), F.lit("symbol").alias("type"), "file_path", "m.symbol", "m.token_cost", "m.skel_cost")
    paths = files.where("file_path is not null").select("file_path").distinct()
    f = paths.select(text.file_id(F.col("file_path")).alias("id"), F.lit("file").alias("type"), "file_path", F.lit(None).cast(s.schema["symbol"].dataType).alias("symbol"), F.lit(0).alias("token_cost"), F.lit(0).alias("skel_cost"))
    return f.unionByName(s)


def defines_edges(symbols: DataFrame) -> DataFrame:
    """One edge for each symbol row, same-named ones too."""
    s = symbols.where("file_path is not null and name is not null")
    return _edge(s.select(text.file_id(F.col("file_path")).alias("src"), text.symbol_id(F.col("file_path"), F.col("name")).alias("dst")), "DEFINES", DEFINES)


def import_edges(imports: DataFrame, files: DataFrame, single: bool = False) -> DataFrame:
    """One edge for each import (file_path, imp) and each other file of its repository (file_path) that the text matches."""
    uses = imports.where("file_path is not null and imp is not null").select("file_path", F.col("imp").alias("text"), repository(F.col("file_path"), single).alias("repo"))
    paths = files.where("file_path is not null").select(F.col("file_path").alias("path"), repository(F.col("file_path"), single).alias("repo")).distinct()
    hits = import_paths.matches(uses.select("repo", "text").distinct(), paths)
    found = uses.join(hits, ["repo", "text"]).where("path <> file_path")
    return _edge(found.select(text.file_id(F.col("file_path")).alias("src"), text.file_id(F.col("path")).alias("dst")), "IMPORTS", IMPORTS)


def call_edges(symbols: DataFrame, single: bool = False) -> DataFrame:
    """One edge for each call: to the symbol of the file that the whole text names (by name or qualified name), else
    the base name; else to every symbol of the repository with that base name."""
    own = symbols.where("file_path is not null and name is not null")
    calls = own.select("file_path", "name", F.explode("calls").alias("c")).select("file_path", "name", text.trim_all(F.col("c")).alias("c")).where("c <> ''")
    calls = calls.groupBy("file_path", "name", "c").agg(F.count(F.lit(1)).alias("times")).withColumn("b", text.base_name(F.col("c")))

    both = F.array_compact(F.array_distinct(F.array("name", "qualified_name")))
    keys = own.select("file_path", F.explode(both).alias("key"), "name", F.coalesce("ordinal", F.lit(0)).alias("ordinal"))
    keys = keys.groupBy("file_path", "key").agg(F.max_by("name", "ordinal").alias("to"))
    whole = keys.select("file_path", F.col("key").alias("c"), F.col("to").alias("whole"))
    base = keys.select("file_path", F.col("key").alias("b"), F.col("to").alias("base"))
    tried = calls.join(whole, ["file_path", "c"], "left").join(base, ["file_path", "b"], "left").withColumn("to", F.coalesce("whole", "base"))
    src = text.symbol_id(F.col("file_path"), F.col("name")).alias("src")
    local = tried.where("to is not null").select(src, text.symbol_id(F.col("file_path"), F.col("to")).alias("dst"), "times")

    open_ = tried.where("to is null").select(src, repository(F.col("file_path"), single).alias("repo"), "b", "times")
    named = own.select(repository(F.col("file_path"), single).alias("repo"), F.col("name").alias("b"), text.symbol_id(F.col("file_path"), F.col("name")).alias("dst"))
    wide = open_.join(named, ["repo", "b"]).where("dst <> src")
    again = lambda df: df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return _edge(again(local), "CALLS", LOCAL_CALL).unionByName(_edge(again(wide), "CALLS", GLOBAL_CALL))


def implements_edges(symbols: DataFrame, single: bool = False) -> DataFrame:
    """One edge for each implemented name and each symbol of the repository with exactly that name."""
    own = symbols.where("file_path is not null and name is not null")
    asks = own.select(text.symbol_id(F.col("file_path"), F.col("name")).alias("src"), repository(F.col("file_path"), single).alias("repo"), F.explode("implements").alias("b"))
    named = own.select(repository(F.col("file_path"), single).alias("repo"), F.col("name").alias("b"), text.symbol_id(F.col("file_path"), F.col("name")).alias("dst"))
    return _edge(asks.join(named, ["repo", "b"]), "IMPLEMENTS", IMPLEMENTS)


def build_edges(symbols: DataFrame, imports: DataFrame, files: DataFrame, single: bool = False) -> DataFrame:
    """All edges of parsed files: symbols, imports (file_path, imp) and files (file_path); names and imports are resolved
    within each repository, or over all files where `single` says that they are one."""
    edges = defines_edges(symbols).unionByName(import_edges(imports, files, single))
    return edges.unionByName(call_edges(symbols, single)).unionByName(implements_edges(symbols, single))
