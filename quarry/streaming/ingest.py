"""Structured Streaming: documents that arrive as files, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest(stream: DataFrame, corpus, checkpoint: str, trigger: dict | None = None):
    """Index every micro-batch of ``stream(id, text)`` into a corpus.

    A batch's number is kept with the version that it made, by the query's id, which lies with its checkpoint: one
    that is run again after a failure changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        ready = batch.where("id is not null and id <> '' and coalesce(text, '') <> ''")
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if ready.head(1):
            corpus.index(ready, batch=(name, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; on a stream, events later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = rows.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: runs of events with no gap as long as ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
