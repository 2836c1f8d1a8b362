"""The file cache and the index as parquet tables that are replaced as a whole, by versions and a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import FILE_CACHE

#: The file that names a table's version.
POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointer(spark: SparkSession, path: str) -> str | None:
    """The version that the table's pointer file names, or None."""
    fs, at = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    name = spark.read.text(f"{path}/{POINTER}").first()
    return name[0].strip() if name else None


def replace(df: DataFrame, path: str) -> None:
    """Writes df as a new version below path, then points to it with one atomic rename.

    A reader sees the version before or the new one, whole; a crash leaves the one before. Two
    versions are kept, so that who has opened the one before can read it to its end.
    """
    spark = df.sparkSession
    before = _pointer(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, new = _fs(spark, f"{path}/{POINTER}-{version}")
    out = fs.create(new)
    out.write(bytearray(version.encode()))
    out.close()
    _, at = _fs(spark, f"{path}/{POINTER}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), conf)
    context.rename(fs.makeQualified(new), fs.makeQualified(at), options)
    for old in fs.listStatus(_fs(spark, path)[1]):
        name = old.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(old.getPath(), True)


def exists(spark: SparkSession, path: str) -> bool:
    return _pointer(spark, path) is not None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of the table that its pointer names."""
    return spark.read.parquet(f"{path}/{_pointer(spark, path)}")


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached entries; a missing table, or one that cannot be read, is an empty cache."""
    schema = StructType.fromDDL(FILE_CACHE)
    version = _pointer(spark, path)
    if version is None:
        return spark.createDataFrame([], schema)
    try:
        kept = spark.read.parquet(f"{path}/{version}")
    except Exception as e:  # noqa: BLE001 - an unreadable version counts as empty
        if not any(w in str(e) for w in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ")):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{version}") if set(schema.names) <= set(kept.columns) else spark.createDataFrame([], schema)


def get(cache: DataFrame, rel_path: str) -> DataFrame:
    return cache.where(F.col("rel_path") == rel_path)


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries in place of those of the same path."""
    return cache.join(entries.select("rel_path"), "rel_path", "left_anti").select(cache.columns).unionByName(entries.select(cache.columns))


def remove(cache: DataFrame, paths: DataFrame) -> DataFrame:
    """The cache without the entries of paths (rel_path)."""
    return cache.join(paths.select("rel_path").distinct(), "rel_path", "left_anti")


def save_index(nodes: DataFrame, edges: DataFrame, path: str, repository: str = "", version: str = "1.0.0") -> None:
    """nodes/, edges/ (of existing nodes) and a metadata/ row below path."""
    spark = nodes.sparkSession
    replace(nodes, f"{path}/nodes")
    kept = edges.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(edges.columns)
    replace(kept, f"{path}/edges")
    n, e = load_index(spark, path)
    files, edge_count = n.where("type = 'file'").count(), e.count()
    replace(
        spark.range(1).select(
            F.lit(version).alias("version"), F.current_timestamp().alias("indexed_at"), F.lit(repository).alias("repository"),
            F.lit(files).alias("files"), F.lit(n.count() - files).alias("symbols"), F.lit(edge_count).alias("edges"),
        ),
        f"{path}/metadata",
    )


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return current(spark, f"{path}/nodes"), current(spark, f"{path}/edges")
