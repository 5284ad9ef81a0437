"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators import chunking, dense, facets, fusion, lexical, pairs, ranking_metrics
from citeweave.plans import sql as S
from citeweave.plans import tables as P
from citeweave.plans.registry import query
from citeweave.session import ensure_checkpoint_dir, stored

_RANKED = ["query_id", "chunk_id", "score", "rank"]


@query(
    "document_frequencies",
    S.with_steps("dfreq", "SELECT term, df FROM dfreq"),
)
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_index(P.chunks(spark, sf_dir)).document_frequencies()


@query(
    "bm25_top10",
    S.with_steps("bm25", "SELECT query_id, chunk_id, score, rank FROM bm25 WHERE rank <= 10"),
)
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(P.chunks(spark, sf_dir))
    return lexical.search(index, P.queries(spark, sf_dir), 10).select(*_RANKED)


@query(
    "bm25_conversation_turns",
    S.with_steps(
        ["tf", "dl", "dfreq", "corpus"],
        "SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 5",
        {
            "turns": f"SELECT DISTINCT conv_id || '/' || turn AS query_id, unnest({S.lexical('text')}) AS term FROM conversations WHERE role = 'user'",
            "ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
                SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
                  / (tf + 1.5 * (0.25 + 0.75 * (dl / avgdl)))), 8) AS score
                FROM turns JOIN tf USING (term) JOIN dl USING (chunk_id) JOIN dfreq USING (term), corpus GROUP BY 1, 2)
                WHERE score > 0""",
        },
    ),
)
def bm25_conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question: a query table that grows with the data."""
    turns = P.table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.col("text").alias("query")
    )
    return lexical.search(lexical.build_index(P.chunks(spark, sf_dir)), turns, 5).select(*_RANKED)


_COSINE = """SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
  round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings a, embeddings b"""


def embedding_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = P.table(spark, sf_dir, "embeddings")
    return (
        rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")),
        rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
    )



DENSE_TOP = (
    f"""WITH s AS ({_COSINE.replace(', 6)', ', 8)')}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
        SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10"""
)


@query("dense_top10", DENSE_TOP)
def dense_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = embedding_sides(spark, sf_dir)
    return dense.search(corpus, asked, 10).select(*_RANKED)


@query("dense_top10_grid", DENSE_TOP)
def dense_top10_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path for query tables beyond the broadcast bound."""
    corpus, asked = embedding_sides(spark, sf_dir)
    return dense.search(corpus, asked, 10, max_broadcast_queries=0, cell_rows=256).select(*_RANKED)


@query(
    "dense_chunks_top10",
    S.with_steps("dense", "SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 10"),
)
def dense_chunks_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.Retriever(spark, sf_dir).dense(P.queries(spark, sf_dir), 10).select(*_RANKED)


@query(
    "backend_equivalence",
    "SELECT vec_id AS query_id, true AS exact_order, 0.0::DOUBLE AS max_score_delta, 1.0::DOUBLE AS overlap_at_k FROM embeddings",
)
def backend_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both dense paths must give the same ranking for every query vector, whatever the size of the table."""
    corpus, asked = embedding_sides(spark, sf_dir)
    left = dense.streamed(corpus, asked, 10)
    right = stored(dense.gridded(corpus, asked, 10, cell_rows=256))
    return fusion.rank_agreement(left, right, 10)


@query(
    "rrf_top10",
    S.with_steps(
        "rrf",
        """SELECT query_id, chunk_id, score, rank, bm25_rank, bm25_score, dense_rank, dense_score,
           concat_ws(',', CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN dense_rank IS NOT NULL THEN 'dense' END) AS retrieved_by
           FROM rrf WHERE rank <= 10""",
    ),
)
def rrf_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = P.Retriever(spark, sf_dir).hybrid(P.queries(spark, sf_dir), 10)
    return hits.select(
        *_RANKED, "bm25_rank", "bm25_score", "dense_rank", "dense_score",
        F.array_join("retrieved_by", ",").alias("retrieved_by"),
    )


@query(
    "rerank_top10",
    S.with_steps(
        "rerank",
        "SELECT query_id, chunk_id, score, rank, hybrid_rank, hybrid_score FROM rerank WHERE rank <= 10",
    ),
)
def rerank_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = P.Retriever(spark, sf_dir).reranked(P.queries(spark, sf_dir), 10)
    return hits.select(*_RANKED, "hybrid_rank", "hybrid_score")


@query("qrels_from_passages", S.with_steps("qrels", "SELECT query_id, chunk_id FROM qrels"))
def qrels_from_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.qrels(P.chunks(spark, sf_dir), P.queries(spark, sf_dir))


_POOL = {
    "pool": """SELECT query_id, chunk_id, max(bm25_rank) AS bm25_rank, max(dense_rank) AS dense_rank, bool_or(carried) AS carried FROM (
        SELECT query_id, chunk_id, rank AS bm25_rank, NULL AS dense_rank, false AS carried FROM bm25 WHERE rank <= 20
        UNION ALL SELECT query_id, chunk_id, NULL, rank, false FROM dense WHERE rank <= 20
        UNION ALL SELECT query_id, chunk_id, NULL, NULL, true FROM qrels) GROUP BY 1, 2""",
}


@query(
    "candidate_pool_blinded",
    S.with_steps(
        ["bm25", "dense", "qrels", "chunk_pages"],
        f"""SELECT p.query_id || ':c' || printf('%03d', row_number() OVER (PARTITION BY p.query_id
                ORDER BY sha256('42:' || p.query_id || ':' || p.chunk_id), p.chunk_id)) AS candidate_id,
             p.query_id, p.chunk_id, c.document_id, g.page_start, g.page_end,
             rtrim(substr({S.collapse('c.text')}, 1, 700)) AS text_preview,
             concat_ws(',', CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END, CASE WHEN dense_rank IS NOT NULL THEN 'dense' END,
               CASE WHEN carried THEN 'v0.1-qrels' END) AS retrieved_by, bm25_rank, dense_rank
           FROM pool p JOIN chunks c USING (chunk_id) JOIN chunk_pages g USING (chunk_id)""",
        _POOL,
    ),
)
def candidate_pool_blinded(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, retriever = P.queries(spark, sf_dir), P.Retriever(spark, sf_dir)
    pool = fusion.candidate_pool(
        retriever.bm25(asked, 20), retriever.dense(asked, 20), P.qrels(retriever.corpus, asked),
        lambda hits: P.chunks_of(spark, sf_dir, hits),
    )
    return pool.select(
        "candidate_id", "query_id", "chunk_id", "document_id", "page_start", "page_end", "text_preview",
        F.array_join("retrieved_by", ",").alias("retrieved_by"), "bm25_rank", "dense_rank",
    )


@query(
    "qrels_from_labels",
    S.with_steps(
        ["bm25", "dense", "qrels"],
        """SELECT query_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS relevant_chunk_ids FROM
           (SELECT p.query_id, p.chunk_id FROM pool p JOIN qrels USING (query_id, chunk_id)) GROUP BY 1""",
        _POOL,
    ),
)
def qrels_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool labelled by passage overlap, turned back into judgments."""
    asked, retriever = P.queries(spark, sf_dir), P.Retriever(spark, sf_dir)
    truth = retriever.stored(P.qrels(retriever.corpus, asked))
    pool = fusion.candidate_pool(
        retriever.bm25(asked, 20), retriever.dense(asked, 20), truth, lambda hits: P.chunks_of(spark, sf_dir, hits)
    )
    labelled = pool.join(truth.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left").withColumn(
        "relevant", F.coalesce("hit", F.lit(False))
    )
    return fusion.qrels_from_labels(labelled).select(
        "query_id", F.array_join("relevant_chunk_ids", ",").alias("relevant_chunk_ids")
    )


def _metrics_sql(source: str) -> str:
    return f"""SELECT t.query_id, t.relevant_count,
        round(coalesce(h5, 0) / t.relevant_count, 6) AS recall_at_5, round(coalesce(h10, 0) / t.relevant_count, 6) AS recall_at_10,
        round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS reciprocal_rank_at_10,
        round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(t.relevant_count, 10) + 1), lambda r: 1.0::DOUBLE / log2(r + 1))), 6) AS ndcg_at_10
      FROM (SELECT query_id, count(*) AS relevant_count FROM qrels GROUP BY 1) t LEFT JOIN (
        SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) AS h10, min(rank) AS first_rank,
          sum(1.0::DOUBLE / log2(rank + 1)) AS gain
        FROM {source} JOIN qrels USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY 1) USING (query_id)"""


@query("ir_metrics_bm25", S.with_steps(["bm25", "qrels"], _metrics_sql("bm25")))
def ir_metrics_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = P.chunks(spark, sf_dir), P.queries(spark, sf_dir)
    return ranking_metrics.per_query(lexical.search(lexical.build_index(corpus), asked, 10), P.qrels(corpus, asked))


_SYSTEMS = [("bm25", "bm25"), ("dense", "dense"), ("hybrid", "rrf"), ("reranked", "rerank")]


@query(
    "ir_metrics_by_system",
    S.with_steps(
        ["rerank", "qrels"],
        " UNION ALL ".join(
            f"""SELECT '{name}' AS system, count(*) AS query_count, round(avg(recall_at_5), 6) AS recall_at_5,
            round(avg(recall_at_10), 6) AS recall_at_10, round(avg(reciprocal_rank_at_10), 6) AS reciprocal_rank_at_10,
            round(avg(ndcg_at_10), 6) AS ndcg_at_10 FROM ({_metrics_sql(step)})"""
            for name, step in _SYSTEMS
        ),
    ),
)
def ir_metrics_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro metrics of all four systems, from one set of indexes and one judgment table."""
    asked, retriever = P.queries(spark, sf_dir), P.Retriever(spark, sf_dir)
    truth = P.qrels(retriever.corpus, asked)
    # Stored rankings keep the two index scans from being repeated per system.
    bm25, dense_hits = retriever.stored(retriever.bm25(asked, 50)), retriever.stored(retriever.dense(asked, 50))
    hybrid = retriever.stored(fusion.fuse(bm25, dense_hits, 20))
    runs = {"bm25": bm25, "dense": dense_hits, "hybrid": hybrid, "reranked": retriever.rescored(hybrid, asked, 10)}
    tagged = None
    for name, hits in runs.items():
        rows = hits.select(F.concat_ws("|", F.lit(name), "query_id").alias("query_id"), "chunk_id", "rank")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    systems = F.explode(F.array(*[F.lit(n) for n in runs]))
    judged = truth.select(systems.alias("system"), "query_id", "chunk_id").select(
        F.concat_ws("|", "system", "query_id").alias("query_id"), "chunk_id"
    )
    rows = ranking_metrics.per_query(tagged, judged)
    return rows.groupBy(F.substring_index("query_id", "|", 1).alias("system")).agg(
        F.count("*").alias("query_count"),
        *[F.round(F.avg(m), 6).alias(m) for m in ranking_metrics.METRICS],
    )


@query(
    "judgment_gaps",
    S.with_steps(
        "qrels",
        "SELECT query_id, 'missing_judgment' AS problem FROM q WHERE query_id NOT IN (SELECT query_id FROM qrels)",
    ),
)
def judgment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = P.chunks(spark, sf_dir), P.queries(spark, sf_dir)
    return ranking_metrics.judgment_gaps(asked, P.qrels(corpus, asked))


# Facet questions: every benchmark item is asked about the next two items.
_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), '\s+', ' ', 'g'))"
_FACET_STEPS = {
    "clean": f"SELECT item_id, {_CLEAN} AS t, count(*) OVER () AS n FROM benchmark",
    "fq": """SELECT a.item_id::VARCHAR AS query_id, a.t AS topic, b.t AS l, c.t AS r,
        'What ' || a.t || ' are shared by ' || b.t || ' and ' || c.t || '?' AS query
        FROM clean a JOIN clean b ON b.item_id = (a.item_id + 1) % a.n JOIN clean c ON c.item_id = (a.item_id + 2) % a.n""",
}


def facet_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.table(spark, sf_dir, "benchmark").select(
        "item_id", F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")).alias("t")
    )
    n = items.agg(F.count("*")).scalar()
    left = items.select(F.pmod(F.col("item_id") - 1, n).alias("item_id"), F.col("t").alias("l"))
    right = items.select(F.pmod(F.col("item_id") - 2, n).alias("item_id"), F.col("t").alias("r"))
    return items.join(left, "item_id").join(right, "item_id").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.concat(F.lit("What "), "t", F.lit(" are shared by "), "l", F.lit(" and "), "r", F.lit("?")).alias("query"),
    )


_SHARED = r"(?i)^\s*(?:what\s+)?(.+?)\s+are\s+shared\s+by\s+(.+?)\s+and\s+(.+?)[?.!]*\s*$"
_FACET_TERMS = "list_filter(regexp_extract_all(lower({}), '[A-Za-z0-9]+'), lambda t: t NOT IN (" + S.literal_list(
    ["a", "an", "and", "aircraft", "aircrafts", "system", "systems", "propulsion", "the"]
) + "))"
_PLAN_STEPS = {
    **_FACET_STEPS,
    "parsed": f"""SELECT query_id, query, regexp_extract(query, '{_SHARED}', 1) AS topic,
        regexp_extract(query, '{_SHARED}', 2) AS lf, regexp_extract(query, '{_SHARED}', 3) AS rf FROM fq""",
    "searches": f"""SELECT query_id || '#0' AS search_id, query_id, 0 AS facet_no, query AS search_query, []::VARCHAR[] AS terms FROM parsed
        UNION ALL SELECT query_id || '#1', query_id, 1, lf || ' ' || topic, list_distinct({_FACET_TERMS.format('lf')}) FROM parsed
        UNION ALL SELECT query_id || '#2', query_id, 2, rf || ' ' || topic, list_distinct({_FACET_TERMS.format('rf')}) FROM parsed""",
}


@query(
    "facet_plan",
    "WITH "
    + ", ".join(f"{n} AS ({b})" for n, b in _PLAN_STEPS.items())
    + " SELECT search_id, query_id, facet_no, search_query, array_to_string(list_sort(terms), ' ') AS required_terms FROM searches",
)
def facet_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.plan_searches(facet_questions(spark, sf_dir)).select(
        "search_id", "query_id", "facet_no", "search_query",
        F.array_join(F.array_sort("required_terms"), " ").alias("required_terms"),
    )


@query(
    "facet_mix",
    S.with_steps(
        ["tf", "dl", "dfreq", "corpus"],
        "SELECT query_id, chunk_id, rank, used_facets, facet_no FROM mixed WHERE rank <= 5",
        {
            **_PLAN_STEPS,
            "sterm": f"SELECT DISTINCT search_id, unnest({S.lexical('search_query')}) AS term FROM searches",
            "shits": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, chunk_id) AS rank FROM (
                SELECT search_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
                  / (tf + 1.5 * (0.25 + 0.75 * (dl / avgdl)))), 8) AS score
                FROM sterm JOIN tf USING (term) JOIN dl USING (chunk_id) JOIN dfreq USING (term), corpus GROUP BY 1, 2)
                WHERE score > 0) WHERE rank <= 15""",
            "matching": """SELECT s.query_id, s.facet_no, h.chunk_id,
                row_number() OVER (PARTITION BY h.search_id ORDER BY h.rank) AS position
                FROM shits h JOIN searches s USING (search_id) JOIN chunks c USING (chunk_id)
                WHERE s.facet_no = 0 OR len(list_filter(s.terms, lambda t: NOT list_contains(regexp_extract_all(lower(c.text), '[A-Za-z0-9]+'), t))) = 0""",
            "used": """SELECT query_id, count(*) FILTER (WHERE facet_no = 1) >= 1 AND count(*) FILTER (WHERE facet_no = 2) >= 1 AS used_facets
                FROM matching GROUP BY 1""",
            "best": """SELECT query_id, chunk_id, used_facets, min({'a': CASE WHEN facet_no > 0 THEN 0 ELSE 1 END, 'b': position, 'c': facet_no}) AS place
                FROM matching JOIN used USING (query_id) WHERE facet_no = 0 OR (used_facets AND position <= 2) GROUP BY 1, 2, 3""",
            "mixed": """SELECT query_id, chunk_id, used_facets, place.c AS facet_no,
                row_number() OVER (PARTITION BY query_id ORDER BY place.a, place.b, place.c) AS rank FROM best""",
        },
    ),
)
def facet_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = P.chunks(spark, sf_dir)
    searches = facets.plan_searches(facet_questions(spark, sf_dir))
    asked = searches.select(F.col("search_id").alias("query_id"), F.col("search_query").alias("query"))
    ensure_checkpoint_dir(spark)
    hits = lexical.search(lexical.build_index(corpus), asked, facets.SEARCH_DEPTH).withColumnRenamed(
        "query_id", "search_id"
    ).checkpoint()
    return facets.mix(hits, searches, P.chunks_of(spark, sf_dir, hits), 5).select("query_id", "chunk_id", "rank", "used_facets", "facet_no")


_NEGATIVE_PAIRS = f"""WITH s AS ({_COSINE.replace(', 6)', ', 8)')} WHERE a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s),
    p AS (SELECT DISTINCT least(query_id, chunk_id) AS left_id, greatest(query_id, chunk_id) AS right_id, score FROM r WHERE rank <= 6)
    SELECT left_id, right_id, score AS cosine_similarity FROM p
    JOIN embeddings a ON a.vec_id = left_id JOIN embeddings b ON b.vec_id = right_id WHERE a.label <> b.label"""


@query("hard_negative_pairs", _NEGATIVE_PAIRS)
def hard_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest pairs whose labels differ; same-label pairs are the excluded ones."""
    rows = P.table(spark, sf_dir, "embeddings")
    near = pairs.ranked_neighbours(rows.select(F.col("vec_id").alias("concept_id"), F.col("embedding").alias("vector")), 6)
    labels = rows.select("vec_id", "label")
    same = (
        near.join(labels.withColumnsRenamed({"vec_id": "anchor_id", "label": "la"}), "anchor_id")
        .join(labels.withColumnsRenamed({"vec_id": "candidate_id", "label": "lb"}), "candidate_id")
        .where("la = lb")
        .select(F.col("anchor_id").alias("left_id"), F.col("candidate_id").alias("right_id"))
    )
    return pairs.hard_negatives(near, same)


_CHUNK_ROWS = S.with_steps(
    "chunk_pages",
    """SELECT c.chunk_id, c.document_id, c.chunk_index, g.page_start, g.page_end, g.n_pages AS page_count, c.text,
         c.word_count, length(c.text) AS character_count, greatest(1, ceil(length(c.text) / 4))::BIGINT AS token_estimate,
         c.source_url, c.sha AS document_sha256
       FROM chunks c JOIN chunk_pages g USING (chunk_id)""",
)


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id", "document_id", "chunk_index", "page_start", "page_end",
        F.size("page_ids").cast("bigint").alias("page_count"), "text", "word_count", "character_count",
        "token_estimate", "source_url", "document_sha256",
    )


@query("chunk_documents", _CHUNK_ROWS)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(P.chunks(spark, sf_dir))


@query("chunk_pages", _CHUNK_ROWS)
def chunk_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(chunking.chunk_pages(chunking.page_records(P.documents(spark, sf_dir))))


@query(
    "chunk_receipts",
    f"""SELECT doc_id AS document_id, count(*) AS page_count, count(*) FILTER (WHERE n > 0) AS nonempty_page_count,
         sum(n)::BIGINT AS total_words,
         CASE WHEN sum(n) = 0 THEN 0 ELSE greatest(0, ceil((sum(n) - 300) / 240.0))::BIGINT + 1 END AS chunk_count
       FROM (SELECT doc_id, len({S.words('raw')}) AS n FROM
         (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents)) GROUP BY 1""",
)
def chunk_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_receipts(chunking.page_records(P.documents(spark, sf_dir)))
