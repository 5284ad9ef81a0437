"""Reciprocal-rank fusion, blinded pools and re-ranking of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions.hashing import blinded_key
from citeweave.operators.scale import fits, running_totals, small, top_k
from citeweave.session import ensure_checkpoint_dir

RRF_K = 60
SOURCE_DEPTH = 50
CANDIDATE_DEPTH = 20


def fuse(bm25: DataFrame, dense: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Full-outer merge of two ranked lists, ordered by fused score.

    Order: fused score desc, best source rank, chunk id. Source scores are
    carried for provenance and never influence the fusion.
    """
    left = bm25.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    right = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    merged = left.join(right, ["query_id", "chunk_id"], "full_outer")

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))

    fused = merged.withColumn("score", F.round(share("bm25_rank") + share("dense_rank"), 12)).withColumn(
        "best_rank", F.least("bm25_rank", "dense_rank")
    )
    ranked = top_k(fused, ["query_id"], [F.desc("score"), F.asc("best_rank"), F.asc("chunk_id")], k)
    return ranked.withColumn("retrieved_by", source_labels())


def source_labels(carried: Column | None = None) -> Column:
    """Retriever names in fixed order."""
    labels = [
        F.when(F.col("bm25_rank").isNotNull(), F.lit("bm25")),
        F.when(F.col("dense_rank").isNotNull(), F.lit("dense")),
    ]
    if carried is not None:
        labels.append(F.when(carried, F.lit("v0.1-qrels")))
    return F.array_compact(F.array(*labels))


def invalid_hits(hits: DataFrame) -> DataFrame:
    """Rows breaking the hit contract: rank pairs, rank bounds, duplicates."""
    paired = (F.col("bm25_rank").isNull() == F.col("bm25_score").isNull()) & (
        F.col("dense_rank").isNull() == F.col("dense_score").isNull()
    )
    sourced = F.col("bm25_rank").isNotNull() | F.col("dense_rank").isNotNull()
    bad_rows = hits.where(~paired | ~sourced | (F.col("rank") < 1)).select(
        "query_id", "chunk_id", F.lit("contract").alias("problem")
    )
    doubled = hits.groupBy("query_id", "chunk_id").count().where("count > 1").select(
        "query_id", "chunk_id", F.lit("duplicate").alias("problem")
    )
    return bad_rows.unionByName(doubled)


def overlap_score(query: Column, text: Column) -> Column:
    """Default pair scorer: share of distinct query tokens found in the text."""
    asked = F.array_distinct(T.lexical_tokens(query))
    found = F.size(F.array_intersect(asked, T.lexical_tokens(text)))
    return F.round(F.coalesce(F.try_divide(found, F.size(asked)), F.lit(0.0)).cast("double"), 6)


PairModel = Callable[[pd.Series, pd.Series], pd.Series]


def model_score(model: PairModel) -> Callable[[Column, Column], Column]:
    """Wrap a batch pair model (for example a cross-encoder) as a scorer."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for query, text in batches:
            yield model(query, text)

    return run


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    scorer: Callable[[Column, Column], Column] = overlap_score,
    depth: int = CANDIDATE_DEPTH,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Re-order fused candidates by a pair score; ties keep the fused order.

    ``candidates`` has at most ``depth`` rows per query. When that bound makes
    them small they are broadcast, so fetching their texts is one scan of the
    corpus and never shuffles it. ``carry`` keeps chunk columns for the evidence
    step, which then needs no second scan.
    """
    bounded = fits(queries, per_row=depth)
    wanted = [c for c in dict.fromkeys(("chunk_id", "text", *carry))]
    paired = chunks.select(*wanted).join(small(candidates, bounded), "chunk_id").join(
        small(queries.select("query_id", "query"), bounded), "query_id"
    )
    scored = paired.select(
        *[F.col(c) for c in carry if c != "chunk_id"],
        "query_id", "chunk_id", F.col("rank").alias("hybrid_rank"), F.col("score").alias("hybrid_score"),
        "bm25_rank", "bm25_score", "dense_rank", "dense_score", "retrieved_by",
        scorer(F.col("query"), F.col("text")).alias("score"),
    )
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("hybrid_rank"), F.asc("chunk_id")], k)


def candidate_pool(
    bm25: DataFrame,
    dense: DataFrame,
    carried: DataFrame,
    chunks: DataFrame | Callable[[DataFrame], DataFrame],
    seed: int = 42,
    preview_characters: int = 700,
) -> DataFrame:
    """Union of two rankings and earlier judgments in blinded order.

    Candidate ids come from the position under a keyed hash, so annotators
    cannot tell which retriever proposed a chunk. ``chunks`` is the chunk table
    or a function that reads the chunks of given hits.
    """
    nothing = F.lit(None)
    tagged = (
        bm25.select(
            "query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"),
            nothing.cast("int").alias("dense_rank"), nothing.cast("double").alias("dense_score"),
            F.lit(False).alias("carried"),
        )
        .unionByName(
            dense.select(
                "query_id", "chunk_id", nothing.cast("int").alias("bm25_rank"),
                nothing.cast("double").alias("bm25_score"), F.col("rank").alias("dense_rank"),
                F.col("score").alias("dense_score"), F.lit(False).alias("carried"),
            )
        )
        .unionByName(
            carried.select(
                "query_id", "chunk_id", nothing.cast("int").alias("bm25_rank"),
                nothing.cast("double").alias("bm25_score"), nothing.cast("int").alias("dense_rank"),
                nothing.cast("double").alias("dense_score"), F.lit(True).alias("carried"),
            )
        )
    )
    merged = tagged.groupBy("query_id", "chunk_id").agg(
        *[F.max(c).alias(c) for c in ("bm25_rank", "bm25_score", "dense_rank", "dense_score", "carried")]
    )
    keyed = merged.withColumn("blind", blinded_key(seed, F.col("query_id"), F.col("chunk_id")))
    # The pool is stored once: its size decides how the chunk texts are fetched.
    ensure_checkpoint_dir(bm25.sparkSession)
    numbered = numbered_candidates(keyed).checkpoint()
    rows = chunks(numbered) if callable(chunks) else chunks
    return rows.select(
        "chunk_id", "document_id", "page_start", "page_end", "citation_url", "source_url", "text"
    ).join(small(numbered, fits(numbered)), "chunk_id").select(
        "candidate_id", "query_id", "chunk_id", "document_id", "page_start", "page_end",
        T.preview(F.col("text"), preview_characters).alias("text_preview"), "citation_url", "source_url",
        source_labels(F.col("carried")).alias("retrieved_by"),
        "bm25_rank", "bm25_score", "dense_rank", "dense_score",
    )


def numbered_candidates(keyed: DataFrame) -> DataFrame:
    """Position per query in blinded order.

    Digests are uniform, so their first two hex digits make 256 even buckets per
    query and the numbering stays parallel for a query with a huge pool.
    """
    placed = running_totals(
        keyed.withColumn("bucket", F.substring("blind", 1, 2)),
        ["query_id"], "bucket", [F.col("blind"), F.col("chunk_id")],
        {"position": F.lit(1).cast("bigint")},
    )
    return placed.withColumn(
        "candidate_id", F.concat(F.col("query_id"), F.format_string(":c%03d", "position"))
    ).drop("bucket")


def qrels_from_labels(pool: DataFrame) -> DataFrame:
    """Labelled pool rows to one judgment per query with sorted chunk ids."""
    return (
        pool.where("relevant")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant_chunk_ids"))
    )


def rank_agreement(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Per query: equal order, overlap at ``k`` and largest score gap by rank."""
    by_rank = left.select("query_id", "rank", F.col("chunk_id").alias("l"), F.col("score").alias("ls")).join(
        right.select("query_id", "rank", F.col("chunk_id").alias("r"), F.col("score").alias("rs")),
        ["query_id", "rank"], "full_outer",
    ).groupBy("query_id").agg(
        F.min(F.col("l").eqNullSafe(F.col("r"))).alias("exact_order"),
        F.round(F.max(F.abs(F.col("ls") - F.col("rs"))), 8).alias("max_score_delta"),
    )
    shared = left.select("query_id", "chunk_id").join(
        right.select("query_id", "chunk_id"), ["query_id", "chunk_id"]
    ).groupBy("query_id").agg((F.count("*") / F.lit(k)).alias("overlap_at_k"))
    return by_rank.join(shared, "query_id", "left").na.fill({"overlap_at_k": 0.0})
