"""Sliding-log rate limiting, as a batch job and as a stateful stream.

A request is admitted when fewer than ``limit`` admitted requests of its key
lie in the window before it; rejected requests do not count. The log of a key
therefore never exceeds ``limit`` entries.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeweave.operators.scale import running_totals

DECISION = "request_id BIGINT, key STRING, allowed BOOLEAN, remaining INT, retry_after_seconds INT"


def _admit(log: deque, now: int, limit: int, window: int) -> tuple[bool, int, int]:
    """Decide one request; times and window are microseconds."""
    while log and log[0] <= now - window:
        log.popleft()
    if len(log) >= limit:
        left = (window - (now - log[0])) / 1e6
        return False, 0, max(1, int(left) + 1)
    log.append(now)
    return True, limit - len(log), 0


def independent_segments(requests: DataFrame, window_micros: int) -> DataFrame:
    """Number the stretches of a key that cannot influence each other.

    After a pause of at least one window the log is empty, so the stretches of a
    hot key can be decided in different tasks. Pauses are found inside time
    buckets plus one lookup of the previous bucket, never by sorting a whole key.
    """
    staged = requests.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
        "bucket", F.floor(F.col("t") / (window_micros * 8))
    )
    last = staged.groupBy("key", "bucket").agg(F.max("t").alias("last_t"))
    before = last.select(
        "key", "bucket", F.lag("last_t").over(Window.partitionBy("key").orderBy("bucket")).alias("before_t")
    )
    inside = Window.partitionBy("key", "bucket").orderBy("t", "request_id")
    gaps = staged.join(before, ["key", "bucket"]).withColumn(
        "gap", F.col("t") - F.coalesce(F.lag("t").over(inside), F.col("before_t"))
    )
    return running_totals(
        gaps, ["key"], "bucket", [F.col("t"), F.col("request_id")],
        {"segment": F.when(F.col("gap").isNull() | (F.col("gap") >= window_micros), 1).otherwise(0)},
    )


def limit_requests(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Decisions for ``requests(request_id, key, ts)`` in time order per key."""
    if limit < 1 or window_seconds < 1:
        raise ValueError("limit and window_seconds must be at least 1")
    window = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for batch in batches:
            rows = []
            for key, segment, t, request_id in zip(batch["key"], batch["segment"], batch["t"], batch["request_id"]):
                if (key, segment) != current:
                    current, log = (key, segment), deque()
                rows.append((request_id, key, *_admit(log, t, limit, window)))
            yield pd.DataFrame(rows, columns=["request_id", "key", "allowed", "remaining", "retry_after_seconds"])

    ordered = (
        independent_segments(requests, window)
        .select("key", "segment", "t", "request_id")
        .repartition("key", "segment")
        .sortWithinPartitions("key", "segment", "t", "request_id")
    )
    return ordered.mapInPandas(run, DECISION)


def limit_stream(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """The same decisions on a stream; state per key is the admitted log.

    Rows of one micro-batch are taken in time order; the trigger's batch size
    bounds what a key can bring at once.
    """
    window = window_seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = deque(state.get[0]) if state.exists else deque()
        arrived = pd.concat(list(batches)).sort_values(["t", "request_id"])
        rows = [
            (request_id, key[0], *_admit(log, t, limit, window))
            for request_id, t in zip(arrived["request_id"], arrived["t"])
        ]
        state.update((list(log),))
        yield pd.DataFrame(rows, columns=["request_id", "key", "allowed", "remaining", "retry_after_seconds"])

    keyed = requests.select("key", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return keyed.groupBy("key").applyInPandasWithState(
        run, DECISION, "log ARRAY<BIGINT>", "append", GroupStateTimeout.NoTimeout
    )
