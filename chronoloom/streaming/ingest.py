"""Streaming ingestion and windowed event statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest as ing


def unique_messages(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Each message id once, within the watermark."""
    return stream.withWatermark("reference", delay).dropDuplicatesWithinWatermark(["uuid"])


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of events by tumbling or sliding windows."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", delay).groupBy(win.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n) of bursts of events less than ``gap`` apart."""
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def start_ingest(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options):
    """Run the batch ingestion on every micro-batch and append its tables; a batch that is run again overwrites its own folder, so a restart adds nothing twice."""

    def each(batch: DataFrame, epoch: int) -> None:
        ing.write_tables(ing.ingest(batch, **options), f"{path}/batch={epoch}", mode="overwrite")

    return unique_messages(stream).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
