"""File-change streams: debounced batches as session windows, and the last change of each path.

A change has project, path, kind (create, write, rename or remove), ts (with time zone, so that it can carry a watermark) and event_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge

GAP = "500 milliseconds"
#: How many changes of the graph, and of its staging, are written at once, and how long they wait at most.
FLUSH_ROWS, FLUSH_EVERY = 1024, "50 milliseconds"
STAGING_ROWS, STAGING_EVERY = 256, "250 milliseconds"


def debounce(change: DataFrame, gap: str | Column = GAP, watermark: str = "0 seconds") -> DataFrame:
    """Per project the batches that a timer of that gap, reset by each change, fires: start, end, changes and paths."""
    w = F.session_window("ts", gap)
    found = change.withWatermark("ts", watermark).groupBy("project", w).agg(F.count("*").alias("n"), F.collect_set("path").alias("paths"))
    return found.select("project", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", F.size("paths").alias("paths"))


def last_changes(change: DataFrame) -> DataFrame:
    return change.groupBy("project", "path").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("ts"))


def stream(change: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, gap: str = GAP, watermark: str = "0 seconds"):
    """A running query that hands every completed batch to publish(batch, id); the checkpoint makes it resume."""
    return debounce(change, gap, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start()


def file_changes(spark: SparkSession, folder: str, project: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the files that are written to a folder, as changes; a file counts when it is first seen or its time is new."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    seen = read.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return seen.select(F.lit(project).alias("project"), "path", F.lit("write").alias("kind"), F.col("modificationTime").alias("ts"), F.xxhash64("path", "modificationTime").alias("event_id"))


def in_batches(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """A running query that hands rows to write(batch, id) at most every so often (all that is there now, without a time).

    How much a batch holds is bounded at the source (maxFilesPerTrigger); a batch that is slow holds back the next one.
    """
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def pending_batches(writes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """in_batches over pending writes: of each batch the last write of an entity counts, weights add up, in the order of the flush."""
    return in_batches(writes, lambda batch, k: apply(merge.pending(batch).orderBy("place", "seq"), k), checkpoint, every)


def once_each(rows: DataFrame, keys: list[str], within: str, ts: str = "ts") -> DataFrame:
    """rows without those whose keys came before, as far back as the watermark reaches; state is dropped beyond it."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def running_activation(updates: DataFrame) -> DataFrame:
    """node_id, activation (the last by seq) and peak of a stream of updates(node_id, activation, seq), kept as state per node."""
    return updates.groupBy("node_id").agg(F.max_by("activation", "seq").alias("activation"), F.max("activation").alias("peak"))


def running_weights(updates: DataFrame) -> DataFrame:
    """edge_id, weight (the last by seq) and the sum of co_activations of a stream of updates, kept as state per edge."""
    return updates.groupBy("edge_id").agg(F.max_by("weight", "seq").alias("weight"), F.sum("co_activations").alias("co_activations"))


def keep_state(state: DataFrame, store: merge.Versions, name: str, key: list[str], checkpoint: str):
    """A running query that brings the store's table up to date with every change of a running state; each batch is one version."""

    def put(batch: DataFrame, _: int) -> None:
        fresh = batch.persist()
        try:
            old = store.read(name) if store.current() and store.has(name) else None
            store.publish({name: fresh if old is None else merge.upsert(old, fresh, key, keep=())})
        finally:
            fresh.unpersist()

    return state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
