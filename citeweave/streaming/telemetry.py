"""Service metrics and checkpoints over streams.

Event-time windows and watermarks are how Spark expresses rolling counters; the
metric definitions (labels, buckets) are those of the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.service_metrics import DURATION_BUCKETS


def windowed_counters(
    events: DataFrame, time: str, labels: list[str], seconds: str, width: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Requests and cumulative duration buckets per window and label set.

    ``time`` may be a zone-less timestamp; it is cast before the watermark.
    Works on a stream (append after the watermark) and on a batch alike.
    """
    staged = events.withColumn("__at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        staged = staged.withWatermark("__at", lateness)
    return staged.groupBy(F.window("__at", width).alias("w"), *labels).agg(
        F.count("*").alias("requests_total"),
        F.sum(seconds).alias("duration_sum"),
        *[F.count_if(F.col(seconds) <= b).alias(f"le_{i}") for i, b in enumerate(DURATION_BUCKETS)],
    ).select(F.col("w.start").alias("window_start"), *labels, "requests_total", "duration_sum",
             *[f"le_{i}" for i in range(len(DURATION_BUCKETS))])


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Running latest checkpoint per thread (``update`` or ``complete`` mode)."""
    rest = [c for c in checkpoints.columns if c != "thread_id"]
    return checkpoints.groupBy("thread_id").agg(F.max_by(F.struct(*rest), "sequence").alias("latest")).select(
        "thread_id", "latest.*"
    )


def log_lines(rows: DataFrame, time: str, level: str, fields: list[str]) -> DataFrame:
    """JSON log lines with an ISO-8601 millisecond timestamp in UTC."""
    stamp = F.date_format(F.col(time).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select(
        F.to_json(F.struct(stamp.alias("timestamp"), F.col(level).alias("level"), *fields)).alias("value")
    )
