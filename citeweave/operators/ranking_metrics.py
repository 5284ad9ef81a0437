"""Retrieval quality of ranked lists against binary judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions 1..k discounted by log2(rank + 1); the ideal list fills the first
# min(relevant, k) positions.
METRIC_DEPTH = 10


def _ideal_gain(relevant: Column, k: int) -> Column:
    gains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(relevant, F.lit(k)).cast("int"))),
        lambda r: F.lit(1.0) / F.log2(r + 1.0),
    )
    return F.aggregate(gains, F.lit(0.0), lambda acc, g: acc + g)


def per_query(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Recall@5/10, RR@10 and NDCG@10 per judged query.

    ``hits(query_id, chunk_id, rank)`` and ``qrels(query_id, chunk_id)``. One
    left join of judgments onto the (short) rankings and one aggregation; the
    judgments of a query are only counted, never collected.
    """
    relevant = qrels.select("query_id", "chunk_id").distinct()
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("relevant_count"))
    found = (
        hits.where(F.col("rank") <= METRIC_DEPTH)
        .select("query_id", "chunk_id", "rank")
        .join(relevant, ["query_id", "chunk_id"], "left_semi")
        .groupBy("query_id")
        .agg(
            F.sum(F.when(F.col("rank") <= 5, 1).otherwise(0)).alias("hits_5"),
            F.count("*").alias("hits_10"),
            F.min("rank").alias("first_rank"),
            F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1.0)).alias("gain"),
        )
    )
    return totals.join(found, "query_id", "left").select(
        "query_id", "relevant_count",
        F.round(F.coalesce(F.col("hits_5"), F.lit(0)) / F.col("relevant_count"), 6).alias("recall_at_5"),
        F.round(F.coalesce(F.col("hits_10"), F.lit(0)) / F.col("relevant_count"), 6).alias("recall_at_10"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank_at_10"),
        F.round(
            F.coalesce(F.col("gain"), F.lit(0.0)) / _ideal_gain(F.col("relevant_count"), METRIC_DEPTH), 6
        ).alias("ndcg_at_10"),
    )


METRICS = ["recall_at_5", "recall_at_10", "reciprocal_rank_at_10", "ndcg_at_10"]


def macro(per_query_rows: DataFrame) -> DataFrame:
    return per_query_rows.agg(
        F.count("*").alias("query_count"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS]
    )


def judgment_gaps(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries without judgment and judgments of unknown queries."""
    judged = qrels.select("query_id").distinct()
    asked = queries.select("query_id")
    return asked.join(judged, "query_id", "left_anti").withColumn("problem", F.lit("missing_judgment")).unionByName(
        judged.join(asked, "query_id", "left_anti").withColumn("problem", F.lit("unknown_query"))
    )
