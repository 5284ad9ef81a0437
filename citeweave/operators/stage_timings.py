"""Timings of retrieval attempts added up per question: a total exists only if every attempt has the part.

All aggregates are sums and counts, so they combine map-side and a question with very many attempts is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ["bm25_ms", "dense_ms", "hybrid_fusion_ms", "reranker_scoring_ms", "facet_overhead_ms"]
COUNTS = ["retrieval_search_count", "facet_search_count"]


def _when_all(name: str, value: Column) -> Column:
    return F.when(F.count(name) == F.count("*"), value).alias(name)


def combined_attempts(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixed timing record per key: milliseconds and counts added, ``facet_used`` if any attempt used facets."""
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        *[_when_all(c, F.round(F.sum(c), 3)) for c in SUMS],
        *[_when_all(c, F.sum(c)) for c in COUNTS],
        _when_all("facet_used", F.bool_or("facet_used")),
    )


def stage_totals(attempts: DataFrame, keys: Sequence[str], timings: str = "timings") -> DataFrame:
    """(keys, stage, attempts, known, total_ms) for timings kept as a map from stage to milliseconds.

    The stages of a key are the union over its attempts; ``total_ms`` is null if an attempt lacks the stage or its value.
    """
    keys = list(keys)
    per_key = attempts.groupBy(*keys).agg(F.count("*").alias("attempts"))
    entries = attempts.select(*keys, F.explode(timings).alias("stage", "ms"))
    summed = entries.groupBy(*keys, "stage").agg(F.count("ms").alias("known"), F.sum("ms").alias("total"))
    return summed.join(per_key, keys).select(
        *keys, "stage", "attempts", "known", F.when(F.col("known") == F.col("attempts"), F.round("total", 3)).alias("total_ms")
    )


def stage_maps(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stage_totals`` back as one map per key, unknown totals as null."""
    entries = F.array_sort(F.collect_list(F.struct("stage", "total_ms")))
    return totals.groupBy(*keys).agg(F.map_from_entries(entries).alias("timings"))


def pair_latency(scorings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scoring cost per pair from ``scorings(query_id, pair_count, seconds)``; no pairs cost 0."""
    seconds = F.sum("seconds")
    return scorings.groupBy(*keys).agg(
        F.count_distinct("query_id").alias("query_count"), F.sum("pair_count").alias("pair_count"),
        F.round(seconds, 6).alias("total_seconds"),
        F.round(F.coalesce(F.try_divide(seconds * 1000.0, F.sum("pair_count")), F.lit(0.0)), 6).alias("milliseconds_per_pair"),
    )
