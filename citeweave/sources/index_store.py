"""Index tables at rest: bucketed postings, vectors and latest-wins upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.lexical import LexicalIndex


def latest_wins(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Insert-or-replace by key: the highest version of each key survives.

    A struct maximum combines map-side, so a key rewritten very often is cheap.
    Ties on version go to the incoming row.
    """
    rest = [c for c in stored.columns if c not in (key, version)]
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("__new", F.lit(1)))
    packed = both.groupBy(key).agg(
        F.max_by(F.struct(version, *rest), F.struct(F.col(version), F.col("__new"))).alias("r")
    )
    return packed.select(key, *[F.col(f"r.{c}").alias(c) for c in stored.columns if c != key])


def save_lexical(index: LexicalIndex, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Store token lists bucketed by chunk so that scoring reads them without a shuffle."""
    index.tokens.write.mode(mode).bucketBy(buckets, "chunk_id").sortBy("chunk_id").saveAsTable(table)


def load_lexical(spark: SparkSession, table: str) -> LexicalIndex:
    return LexicalIndex(spark.table(table), stored=True)


def save_vectors(vectors: DataFrame, path: str, model: str, mode: str = "overwrite") -> None:
    """Vectors and chunk columns in one table plus a one-row manifest."""
    vectors.write.mode(mode).parquet(f"{path}/vectors")
    vectors.agg(
        F.lit(model).alias("model_name"), F.count("*").alias("chunk_count"),
        F.max(F.size("vector")).alias("dimension"),
    ).write.mode(mode).parquet(f"{path}/manifest")


def load_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Load vectors after checking model, count and dimension against the manifest."""
    vectors = spark.read.parquet(f"{path}/vectors")
    manifest = spark.read.parquet(f"{path}/manifest").first()
    found = vectors.agg(
        F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")
    ).first()
    if manifest.model_name != model:
        raise ValueError(f"index was built with {manifest.model_name}")
    if found.n != manifest.chunk_count or {found.low, found.high} != {manifest.dimension}:
        raise ValueError("index does not match its manifest")
    return vectors


def index_mismatch(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunk ids present on one side only."""
    left, right = chunks.select("chunk_id"), vectors.select("chunk_id")
    return left.join(right, "chunk_id", "left_anti").withColumn("problem", F.lit("no_vector")).unionByName(
        right.join(left, "chunk_id", "left_anti").withColumn("problem", F.lit("no_chunk"))
    )
