"""Scanning of source repositories with Spark's binaryFile source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def _found(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size, mtime_ns, content) of every file below root; contents are read only where they are selected."""
    root = root.rstrip("/")
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    )
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    below = root if root.startswith("/") else "/" + root.split(":", 1)[-1].lstrip("/")
    rel = F.translate(F.substring(plain, len(below) + 2, 2**31 - 1), "\\", "/")
    return found.select(rel.alias("rel_path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size, mtime_ns) of the files below root that a scan takes."""
    return _found(spark, root).where(~text.is_ignored(F.col("rel_path"), F.col("size"))).select("rel_path", "size", "mtime_ns")


def scan(spark: SparkSession, root: str, extra_ignored: list[str] = (), max_kb: int = text.MAX_FILE_KB) -> DataFrame:
    """Files (rel_path, content, size, mtime_ns, checksum, ext) below root that are not ignored.

    The rules apply to the segments below the root, not to the root's own name. Unreadable files are skipped.
    """
    kept = _found(spark, root).where(~text.is_ignored(F.col("rel_path"), F.col("size"), list(extra_ignored), max_kb))
    return kept.select("rel_path", F.col("content").cast("string").alias("content"), "size", "mtime_ns", text.checksum(F.col("content")).alias("checksum"), text.extension(F.col("rel_path")).alias("ext"))
