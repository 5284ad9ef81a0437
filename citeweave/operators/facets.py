"""Facet-aware evidence selection for "X are shared by A and B" questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.scale import fits, small, top_k

SEARCH_DEPTH = 15
FACET_QUOTA = 2
MINIMUM_MATCHES = 1


def plan_searches(queries: DataFrame) -> DataFrame:
    """One search row per query, plus one per facet when the question has two.

    ``facet_no`` 0 is the original question. Facet searches carry the terms a
    hit must contain.
    """
    whole = T.strip(F.col("query"))
    parts = queries.select(
        "query_id", "query",
        *[T.strip(F.regexp_extract(whole, T.SHARED_BY, i)).alias(n) for i, n in enumerate(("topic", "left", "right"), 1)],
    )
    planned = parts.withColumn("left_terms", T.facet_terms(F.col("left"))).withColumn(
        "right_terms", T.facet_terms(F.col("right"))
    ).withColumn("faceted", (F.col("topic") != "") & (F.size("left_terms") > 0) & (F.size("right_terms") > 0))
    none = F.array().cast("array<string>")

    def search(number: int, text, terms):
        return F.struct(
            F.lit(number).alias("facet_no"), text.alias("search_query"), terms.alias("required_terms")
        )

    searches = F.when(
        F.col("faceted"),
        F.array(
            search(0, F.col("query"), none),
            search(1, F.concat_ws(" ", "left", "topic"), F.col("left_terms")),
            search(2, F.concat_ws(" ", "right", "topic"), F.col("right_terms")),
        ),
    ).otherwise(F.array(search(0, F.col("query"), none)))
    return planned.select("query_id", "faceted", F.explode(searches).alias("s")).select(
        F.concat_ws("#", "query_id", "s.facet_no").alias("search_id"),
        "query_id", "faceted", "s.facet_no", "s.search_query", "s.required_terms",
    )


def mix(
    hits: DataFrame, searches: DataFrame, chunks: DataFrame, k: int = 5,
    quota: int = FACET_QUOTA, minimum_matches: int = MINIMUM_MATCHES,
) -> DataFrame:
    """Interleave facet hits, then the original ranking.

    ``hits(search_id, chunk_id, rank, score)`` is cut to the search depth or ``k``, whichever is larger, so
    every per-query window here is bounded. The interleaving is one sort key
    ``(phase, position, facet_no)`` with the smallest key kept per chunk.
    """
    depth = max(k, SEARCH_DEPTH)
    hits = hits.where(F.col("rank") <= depth)
    bounded = fits(searches, per_row=depth)
    placed = chunks.select("chunk_id", "text").join(
        small(hits.join(small(searches, bounded), "search_id"), bounded), "chunk_id"
    )
    matching = placed.where(
        (F.col("facet_no") == 0)
        | T.contains_all_terms(T.token_set(F.col("text")), F.col("required_terms"))
    )
    by_rank = Window.partitionBy("search_id").orderBy("rank")
    positioned = matching.withColumn("position", F.row_number().over(by_rank))
    counts = (
        positioned.groupBy("query_id")
        .agg(
            F.sum(F.when(F.col("facet_no") == 1, 1).otherwise(0)).alias("n1"),
            F.sum(F.when(F.col("facet_no") == 2, 1).otherwise(0)).alias("n2"),
        )
        .select("query_id", ((F.col("n1") >= minimum_matches) & (F.col("n2") >= minimum_matches)).alias("used_facets"))
    )
    usable = positioned.join(counts, "query_id").where(
        (F.col("facet_no") == 0) | (F.col("used_facets") & (F.col("position") <= quota))
    )
    key = F.struct(
        F.when(F.col("facet_no") > 0, 0).otherwise(1).alias("phase"),
        F.col("position").alias("position"),
        F.col("facet_no").alias("facet_no"),
    )
    best = usable.groupBy("query_id", "chunk_id", "used_facets").agg(
        F.min(key).alias("place"), F.min_by("score", key).alias("score")
    )
    return top_k(best, ["query_id"], [F.asc("place")], k).select(
        "query_id", "chunk_id", "rank", "score", "used_facets", F.col("place.facet_no").alias("facet_no")
    )
