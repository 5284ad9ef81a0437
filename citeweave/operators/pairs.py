"""Hard-negative pairs: nearest concepts of another label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators import dense


def pair_key(left: Column, right: Column) -> Column:
    return F.concat_ws("|", F.least(left, right), F.greatest(left, right))


def ranked_neighbours(concepts: DataFrame, k: int, **search) -> DataFrame:
    """Nearest other concepts per concept, ``concepts(concept_id, vector)``.

    Block-wise exact top-k instead of all pairs: what leaves a task is ``k``
    rows per concept.
    """
    corpus = concepts.select(F.col("concept_id").alias("chunk_id"), "vector")
    queries = concepts.select(F.col("concept_id").alias("query_id"), "vector")
    return dense.search(corpus, queries, k, exclude_self=True, **search).select(
        F.col("query_id").alias("anchor_id"), F.col("chunk_id").alias("candidate_id"),
        F.col("score").alias("cosine_similarity"), "rank",
    )


def hard_negatives(neighbours: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Unordered neighbour pairs once each, without excluded relationships."""
    pairs = neighbours.select(
        F.least("anchor_id", "candidate_id").alias("left_id"),
        F.greatest("anchor_id", "candidate_id").alias("right_id"),
        "cosine_similarity",
    ).groupBy("left_id", "right_id").agg(F.max("cosine_similarity").alias("cosine_similarity"))
    if excluded is None:
        return pairs
    ordered = excluded.select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")
    )
    return pairs.join(ordered, ["left_id", "right_id"], "left_anti")
