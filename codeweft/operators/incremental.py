"""Incremental indexing: what changed against the cache, parsing of that only, and the new graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..parsers import registry


def classify(files: DataFrame, cache: DataFrame, keys: list[str] = ("rel_path",)) -> DataFrame:
    """(*keys, status) of files and cached entries (*keys, size, mtime_ns, checksum), each key once.

    'cached' if size and modification time are equal or the checksum is, else 'modified'; 'added'
    if there is no entry, 'deleted' if there is no file. Null equals nothing.
    """
    keys = list(keys)
    cols = ["size", "mtime_ns", "checksum"]
    f = files.select(*keys, *cols, F.lit(True).alias("here"))
    c = cache.select(*keys, *[F.col(x).alias(f"{x}_") for x in cols], F.lit(True).alias("there"))
    same = ((F.col("size") == F.col("size_")) & (F.col("mtime_ns") == F.col("mtime_ns_"))) | (F.col("checksum") == F.col("checksum_"))
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull(), "added").when(F.coalesce(same, F.lit(False)), "cached").otherwise("modified")
    return f.join(c, keys, "full_outer").select(*keys, status.alias("status"))


def stats(classified: DataFrame) -> DataFrame:
    """One row: discovered, added, modified, deleted and cached."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return classified.agg(
        n("added", "modified", "cached").alias("discovered"), *[n(s).alias(s) for s in ("added", "modified", "deleted", "cached")]
    )


def reindex(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(classified, symbols, imports, cache) after a pass over files (rel_path, content, size, mtime_ns, checksum).

    Only added and modified files are parsed. A file without a parser, or that cannot be parsed,
    gets no new entry: the one is added again on each pass, the other keeps its old entry.
    """
    classified = classify(files, cache)
    changed = files.join(classified.where("status in ('added', 'modified')").select("rel_path"), "rel_path", "left_semi")
    symbols, imports, parsed = registry.parse(changed.select(F.col("rel_path").alias("file_path"), "content"))

    fresh = changed.join(parsed.select(F.col("file_path").alias("rel_path")), "rel_path", "left_semi")
    per_symbols = symbols.groupBy(F.col("file_path").alias("rel_path")).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*symbols.columns).alias("s")))).alias("o"))
    per_imports = imports.groupBy(F.col("file_path").alias("rel_path")).agg(F.array_sort(F.collect_list(F.struct("pos", "imp"))).alias("i"))
    entry = fresh.join(per_symbols, "rel_path", "left").join(per_imports, "rel_path", "left").select(
        "rel_path", "size", "mtime_ns", "checksum", F.coalesce(F.transform("o", lambda x: x["s"]), F.array()).alias("symbols"), F.coalesce(F.transform("i", lambda x: x["imp"]), F.array().cast("array<string>")).alias("imports")
    )
    kept = cache.join(classified.where("status in ('modified', 'cached')").select("rel_path"), "rel_path", "left_semi").join(entry.select("rel_path"), "rel_path", "left_anti")
    new = kept.select(entry.columns).unionByName(entry)
    all_symbols = new.select(F.inline("symbols"))
    all_imports = new.select(F.col("rel_path").alias("file_path"), F.posexplode("imports").alias("pos", "imp"))
    return classified, all_symbols, all_imports, new
