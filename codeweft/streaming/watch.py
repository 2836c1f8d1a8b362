"""Debounced change events: one burst for each quiet period, with the distinct paths in it."""

from __future__ import annotations

from collections.abc import Callable
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..schemas import FS_EVENTS
from ..sources import repository, store

#: Quiet time that ends a burst. Fixed value.
QUIET = "300 milliseconds"
#: The repository of events that only let time go on.
BEAT = "\x00beat"


def bursts(events: DataFrame, quiet: str = QUIET, lateness: str | None = None) -> DataFrame:
    """(repo_id, started_at, ended_at, events, paths) of events (repo_id, path, op, ts), batch or streaming.

    Ignored paths and rows with nulls in repo_id, path or ts are dropped; paths are sorted. A
    stream needs `lateness`, the watermark's delay; its last burst comes once the watermark has passed it.
    """
    events = events.withWatermark("ts", lateness) if lateness else events
    kept = events.where("repo_id is not null and path is not null and ts is not null").where(~text.is_ignored(F.col("path"), F.lit(None)))
    grouped = kept.groupBy("repo_id", F.session_window("ts", quiet).alias("w"))
    found = grouped.agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_set("path")).alias("paths"))
    return found.select("repo_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events", "paths")


def watch(events: DataFrame, on_burst: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = QUIET, lateness: str = "1 second", once: bool = False) -> StreamingQuery:
    """Calls on_burst(bursts, batch id) for each micro-batch of a stream of events that closes a burst.

    Readers keep the index version they have until the callback has published the next.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch = batch.where(F.col("repo_id") != BEAT)
        if not batch.isEmpty():
            on_burst(batch, batch_id)

    writer = bursts(events, quiet, lateness).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if once else writer).start()


def file_events(spark: SparkSession, root: str, listing: str, repo_id: str = "") -> DataFrame:
    """(repo_id, path, op, ts) of the files below root that were written or removed since the listing kept at `listing`, which is replaced.

    Only names, sizes and times are read. The first listing gives no events. Ignored paths give none.
    """
    now = repository.listing(spark, root)
    if not store.exists(spark, listing):
        store.replace(now, listing)
        return spark.createDataFrame([], FS_EVENTS)
    before = store.current(spark, listing)
    store.replace(now, listing)
    now = store.current(spark, listing).select("rel_path", F.struct("size", "mtime_ns").alias("now"))
    both = now.join(before.select("rel_path", F.struct("size", "mtime_ns").alias("old")), "rel_path", "full_outer").where("not (now <=> old)")
    op = F.when(F.col("now").isNull(), "remove").otherwise("write")
    return both.select(F.lit(repo_id).alias("repo_id"), F.col("rel_path").alias("path"), op.alias("op"), F.current_timestamp().alias("ts"))


def follow(spark: SparkSession, root: str, folder: str, on_burst: Callable[[DataFrame, int], None], stop: Event, every: float = 1.0, quiet: str = QUIET) -> StreamingQuery:
    """Watches root until `stop` is set: lists it every so many seconds, appends events to a table in folder and gives bursts of them to on_burst.

    Each listing appends a beat too, an event of no repository, so that time goes on and the last burst is closed.
    """
    events = f"{folder}/events"
    spark.createDataFrame([], FS_EVENTS).write.mode("append").parquet(events)

    def poll() -> None:
        try:
            while not stop.wait(every):
                found = file_events(spark, root, f"{folder}/listing", root)
                beat = spark.range(1).select(F.lit(BEAT).alias("repo_id"), F.lit(BEAT).alias("path"), F.lit("beat").alias("op"), F.current_timestamp().alias("ts"))
                found.unionByName(beat).coalesce(1).write.mode("append").parquet(events)
        except Exception:  # the session may end in the middle of a listing
            if not stop.is_set():
                raise

    file_events(spark, root, f"{folder}/listing", root)
    Thread(target=poll, daemon=True).start()
    return watch(spark.readStream.schema(FS_EVENTS).parquet(events), on_burst, f"{folder}/checkpoint", quiet, "0 seconds")
