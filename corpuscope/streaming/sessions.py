"""Expiring sessions over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.history import SESSION_TTL, event_spans, merge_spans, session_rows
from corpuscope.streaming.tables import BUCKET_BYTES, read_table, table_stream


def session_stream(events: DataFrame, keys, ts: str = "ts", gap_seconds: int = SESSION_TTL, lateness: str = "1 hour") -> DataFrame:
    """Sessions closed by the watermark, in append mode.

    Spark merges events into session state per key; an event later than ``lateness`` behind the newest one is
    dropped, and a session appears once the watermark passes its end.
    """
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", lateness)
    window = F.session_window("__ts", f"{gap_seconds} seconds")
    return timed.groupBy(*keys, window.alias("w")).agg(
        F.max("__ts").alias("last_activity"), F.count(F.lit(1)).alias("events")
    ).select(
        *keys, F.col("w.start").alias("created_at"), "last_activity", F.col("w.end").alias("expires_at"), "events"
    )


def session_table_stream(events: DataFrame, path: str, checkpoint: str, keys, ts: str = "ts", gap_seconds: int = SESSION_TTL,
                         bucket_bytes: int = BUCKET_BYTES):
    """Writer that keeps all sessions, open and closed, as a table; start it with a trigger.

    Each micro-batch is reduced to spans first and merged into the spans of the buckets it touches, so events may come in
    any order and none is too late.
    """
    return table_stream(
        events, path, checkpoint, keys,
        lambda batch: merge_spans(event_spans(batch, keys, ts, gap_seconds), keys, gap_seconds),
        lambda rows: merge_spans(rows, keys, gap_seconds), bucket_bytes)


def read_sessions(spark: SparkSession, path: str, keys, gap_seconds: int = SESSION_TTL) -> DataFrame:
    """Current sessions of a table kept by :func:`session_table_stream`, as the batch operator gives them."""
    return session_rows(read_table(spark, path), keys, gap_seconds)
