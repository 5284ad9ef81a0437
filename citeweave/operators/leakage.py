"""Overlap of examples with protected evaluation material."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.scale import fits, small


def _first_reference(values: DataFrame, normalize: bool) -> DataFrame:
    """Smallest reference id per text digest; blank texts are left out."""
    text = T.normalize_training_text(F.col("text")) if normalize else F.col("text")
    return (
        values.select(F.col("ref"), text.alias("text")).where("text <> ''")
        .groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("ref").alias("protected_reference"))
    )


def _matches(rows: DataFrame, column: str, protected: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """Exact matches, and normalized ones only where no exact match exists.

    Both digests are looked up in one pass over the examples. A protected set
    measured to be small is broadcast; otherwise digests are shuffled, not texts.
    """
    exact = _first_reference(protected, False).withColumnsRenamed(
        {"digest": "exact_digest", "protected_reference": "exact_ref"}
    )
    loose = _first_reference(protected, True).withColumnsRenamed(
        {"digest": "loose_digest", "protected_reference": "loose_ref"}
    )
    keyed = rows.select(
        "example_id",
        F.sha2(column, 256).alias("exact_digest"),
        F.sha2(T.normalize_training_text(F.col(column)), 256).alias("loose_digest"),
    )
    bounded = fits(protected.select("ref"))
    found = keyed.join(small(exact, bounded), "exact_digest", "left").join(
        small(loose, bounded), "loose_digest", "left"
    )
    return found.where("exact_ref IS NOT NULL OR loose_ref IS NOT NULL").select(
        F.when(F.col("exact_ref").isNotNull(), kinds[0]).otherwise(kinds[1]).alias("kind"),
        "example_id", F.coalesce("exact_ref", "loose_ref").alias("protected_reference"),
    )


def audit(
    examples: DataFrame, protected_queries: DataFrame, protected_answers: DataFrame, protected_documents: DataFrame
) -> DataFrame:
    """Findings ``(kind, example_id, protected_reference)``.

    ``examples(example_id, query, answer, refused, document_ids)``; protected
    tables have ``ref`` and ``text`` (queries, answers) or ``document_id``.
    Refused examples are not checked for answers.
    """
    ids = examples.join(
        protected_queries.select(F.col("ref").alias("example_id")).distinct(), "example_id", "left_semi"
    ).select(
        F.lit("protected_example_id").alias("kind"), "example_id", F.col("example_id").alias("protected_reference")
    )
    queries = _matches(examples, "query", protected_queries, ("exact_query", "normalized_query"))
    answers = _matches(
        examples.where(~F.col("refused")), "answer", protected_answers,
        ("exact_target_answer", "normalized_target_answer"),
    )
    documents = (
        examples.select("example_id", F.explode(F.array_distinct("document_ids")).alias("document_id"))
        .join(protected_documents.select("document_id").distinct(), "document_id", "left_semi")
        .select(
            F.lit("protected_source_document").alias("kind"), "example_id",
            F.col("document_id").cast("string").alias("protected_reference"),
        )
    )
    return ids.unionByName(queries).unionByName(documents).unionByName(answers)


def duplicate_texts(rows: DataFrame, column: str, normalize: bool) -> DataFrame:
    """Texts carried by more than one row: digest, count and smallest id."""
    text = T.normalize_training_text(F.col(column)) if normalize else F.col(column)
    return rows.select("example_id", F.sha2(text, 256).alias("digest")).groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("example_id").alias("first_example_id")
    ).where("copies > 1")


def shared_documents(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents present on both sides (must be empty for disjoint splits)."""
    return left.select("document_id").intersect(right.select("document_id"))
