"""Adapters from the driver's tables to the engine's records."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions import vectors as V
from citeweave.operators import chunking, dense, fusion, lexical
from citeweave.operators.evidence import EVIDENCE_FIELDS
from citeweave.operators.scale import fits, small
from citeweave.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for inputs that arrive in fewer splits than there are cores.

    Large inputs keep their file splits and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_nested(documents(spark, sf_dir))


def chunks_of(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """Chunks of the documents that ``hits(chunk_id)`` come from.

    Filtering documents first keeps text and page work off everything else.
    """
    found = F.split_part("chunk_id", F.lit(":"), F.lit(1)).cast("bigint")
    ids = hits.select(found.alias("doc_id")).distinct()
    return chunking.chunk_nested(documents(spark, sf_dir).join(small(ids, fits(ids)), "doc_id", "left_semi"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
    )


def shingles(rows: DataFrame, key: str, text, size: int = 8) -> DataFrame:
    """Digests of all ``size``-word windows of a normalized text."""
    # One match per word that starts a whole window; the outer form keeps Spark from building all windows a second time.
    window = f"(?=((?:[a-z0-9]++ ){{{size - 1}}}[a-z0-9]++))[a-z0-9]++"
    windows = F.array_distinct(F.regexp_extract_all(T.normalize_semantic_text(text), F.lit(window), F.lit(1)))
    return rows.select(key, F.explode_outer(windows).alias("window")).where("window IS NOT NULL").select(
        key, F.xxhash64("window").alias("shingle")
    )


def qrels(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """A chunk is relevant when it shares an eight-word passage with the query."""
    wanted = shingles(asked, "query_id", F.col("query"))
    held = shingles(corpus, "chunk_id", F.col("text"))
    return held.join(small(wanted, fits(wanted)), "shingle").select("query_id", "chunk_id").distinct()


def chunk_vectors(corpus: DataFrame) -> DataFrame:
    return corpus.select("chunk_id", V.encode(F.col("text")).alias("vector"))


def query_vectors(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", V.encode(F.col("query")).alias("vector"))


class Retriever:
    """Lexical and dense indexes over one corpus, queried by tables of questions."""

    def __init__(self, spark: SparkSession, sf_dir: str, source_depth: int = 50, candidate_depth: int = 20) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.corpus = chunks(spark, sf_dir)
        self.source_depth = source_depth
        self.candidate_depth = candidate_depth

    @cached_property
    def index(self) -> lexical.LexicalIndex:
        """Tokens, written once for all rankings."""
        return lexical.build_index(self.corpus).kept()

    @cached_property
    def vectors(self) -> DataFrame:
        """Chunk vectors, written once for all rankings."""
        return self.stored(chunk_vectors(self.corpus))

    def bm25(self, asked: DataFrame, k: int) -> DataFrame:
        return lexical.search(self.index, asked, k)

    def dense(self, asked: DataFrame, k: int) -> DataFrame:
        return dense.search(self.vectors, query_vectors(asked), k)

    def hybrid(self, asked: DataFrame, k: int) -> DataFrame:
        return fusion.fuse(self.bm25(asked, self.source_depth), self.dense(asked, self.source_depth), k)

    def reranked(self, asked: DataFrame, k: int) -> DataFrame:
        """Re-ranked hits with the chunk columns the evidence step needs."""
        return self.rescored(self.stored(self.hybrid(asked, self.candidate_depth)), asked, k)

    def stored(self, hits: DataFrame) -> DataFrame:
        """Rankings are short and read more than once: keep them, not their lineage."""
        ensure_checkpoint_dir(self.spark)
        return hits.checkpoint()

    def rescored(self, candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        return fusion.rerank(
            candidates, asked, chunks_of(self.spark, self.sf_dir, candidates), k, depth=self.candidate_depth,
            carry=("text", *EVIDENCE_FIELDS),
        )
