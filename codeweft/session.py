"""Session helpers: a default session, table loading and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "*", partitions: int = 8, app: str = "codeweft") -> SparkSession:
    """A local session with the settings the engine expects from a cluster session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Where neither is set, a temporary folder is taken on a local master only; on a cluster each
    machine would have its own, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {sc.master} share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="codeweft-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs only the tasks of the current step, since earlier steps are read
    back from these tables. What is left of them goes with close(), at the latest with the session's JVM.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.step = 0
        fs, at = self._place(self.root)
        fs.deleteOnExit(at)

    def _place(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def cut(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """df written as a table and read back."""
        path = f"{self.root}/{self.step}"
        self.step += 1
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def cut_counting(self, df: DataFrame, **counts) -> tuple[DataFrame, dict]:
        """cut(), with aggregates observed while the table is written."""
        seen = Observation()
        back = self.cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]))
        return back, {k: v or 0 for k, v in seen.get.items()}

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that no later step reads."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                fs, at = self._place(path)
                fs.delete(at, True)

    def close(self) -> None:
        """Deletes all tables, once the results made from them are written."""
        fs, at = self._place(self.root)
        fs.delete(at, True)


#: Rows up to which a side may be broadcast: some 20 MB of short rows.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if its counted rows are few, else as it is."""
    return F.broadcast(df) if rows <= most else df
