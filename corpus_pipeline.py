"""Five stages from raw documents to token ids; each works on all rows that the one before kept.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of ``documents``. ``run`` writes every stage as Parquet to the shared checkpoint
folder and reads it again for the next, so a lost executor costs at most the stage at work.

Nulls in any column, empty tables and repeated rows pass: a null id is kept by the stages that decide by
id, a null text scores like an empty one in the first stage and has null ids in the last. Rows with the
same id are one document. Columns beyond those of ``documents`` travel along until the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import decontaminate, ngram_join, quality, secret_scan, sentencepieces
from citeweave.llm.common import one_label, stored, table
from citeweave.session import ensure_checkpoint_dir, ship_package

LEAST_QUALITY = 0.3
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject. Trusted positives are all labels 1."""
    ship_package(spark)
    positives = one_label(table(spark, sf_dir, "labels"), "doc_id", "quality").where("y = 1")
    rows = quality.training_rows(docs, positives)
    model = quality.fit(rows)
    columns = docs.columns
    named = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(columns)}
    scored = quality.score(quality.featurise(docs, named), model, list(named))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, Jaccard 0.8)."""
    ship_package(spark)
    placed = ngram_join.join(docs)
    copies = stored(placed.where("doc_id <> component_id").select("doc_id"))
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage or paraphrase of a benchmark item."""
    ship_package(spark)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(stored(found.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind; ``n_chars`` counts the new text."""
    ship_package(spark)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids): the pieces of every whole text."""
    ship_package(spark)
    keep = {c: F.col(c) for c in ("doc_id", "lang", "source")}
    encoded = sentencepieces.encode(docs, sentencepieces.load(PIECES), keep)
    return encoded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode),
]
ORACLE_SQL = None  # a fitted classifier decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
