"""Event streams (R3, R5, R12, P16) and event-time windows (an addition of this engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import json_ops


def subscribed(events: DataFrame, types: list[str]) -> DataFrame:
    """Events of the given types, of a batch or a stream."""
    return events.filter(F.col("event_type").isin(*types))


def change_events(changes: DataFrame, workspace_id: int) -> DataFrame:
    """Events of debounced changes (path, kind)."""
    name = F.concat(F.lit("File"), F.col("kind"))
    return changes.select(name.alias("event_type"), json_ops.payload(workspace_id=F.lit(workspace_id), relative_path=F.col("path")).alias("payload"))


def change_jobs(changes: DataFrame, workspace_id: int) -> DataFrame:
    """Index jobs of debounced changes; deletions make none."""
    return changes.filter("kind <> 'Deleted'").select(F.lit("index_document").alias("job_type"), json_ops.payload(workspace_id=F.lit(workspace_id), relative_path=F.col("path")).alias("payload"), F.lit("queued").alias("status"))


def publish(changes: DataFrame, workspace_id: int, events_path: str, jobs_path: str, checkpoint: str) -> StreamingQuery:
    """A stream of changes into the event log and the job table; a repeated batch is written
    to its own folder again, so both hold each batch once."""
    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        change_events(batch, workspace_id).write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        change_jobs(batch, workspace_id).write.mode("overwrite").parquet(f"{jobs_path}/batch={number}")
        batch.unpersist()

    return changes.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(events: DataFrame, name: str) -> StreamingQuery:
    """A stream into a table in memory, for tests."""
    return events.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str, size: str, late: str | None = None) -> DataFrame:
    """Addition: events by type and event-time window; with ``late`` older ones of a stream drop out."""
    own = events.withWatermark(time_col, late) if late else events
    return own.groupBy(F.window(time_col, size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, time_col: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    """Addition: sessions of a key that end after a gap."""
    own = events.withWatermark(time_col, late) if late else events
    return own.groupBy(by, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
