"""Continuous ingest and windows with Structured Streaming."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.operators.store import Store


def item_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON Lines files of a folder as a stream of reader rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(folder)


def ingest_available(stream: DataFrame, store: Store, checkpoint: str, now: int | None = None) -> None:
    """Inserts what is there into the store and stops; started again it goes on where it was.

    Deduplication is an anti join against the stored items, so the state is the
    store itself and doesn't grow in the stream.
    """

    def insert(batch: DataFrame, _id: int) -> None:
        if not batch.isEmpty():
            store.insert(batch, now or int(time.time() * 1000))

    stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, *, time_column: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and key; on a stream, rows later than the watermark are left out."""
    marked = events.withWatermark(time_column, late) if events.isStreaming else events
    got = marked.groupBy(F.window(time_column, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), F.col(key), "n", "total")


def sessions(events: DataFrame, *, time_column: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key separated by at least ``gap``."""
    marked = events.withWatermark(time_column, late) if events.isStreaming else events
    got = marked.groupBy(F.session_window(time_column, gap), key).agg(F.count("*").alias("n"))
    return got.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col(key), "n")
