"""Invariants of supervised rows, and plans resolved to their frozen evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.rules import Rule, at_least, at_most, each, filled, holds, lacks, unique, when, within

# Phrases that a drafted question must not contain.
META_PHRASES = [
    "provided evidence", "supplied evidence", "according to the evidence", "based on the evidence", "provided excerpts",
    "supplied excerpts", "according to the excerpts", "based on the excerpts", "training data", "training example",
]


def example_rules(
    evidence: Column | None = None, claims: Column | None = None, refused: Column | None = None, max_claims: Column | None = None
) -> list[Rule]:
    """Rules of a grounded example: ``evidence`` (evidence_id, chunk_id, document_id, text), ``claims`` (text,
    evidence_ids), whether it refuses, and its claim limit."""
    evidence = F.col("evidence") if evidence is None else evidence
    claims = F.col("claims") if claims is None else claims
    refused = F.col("insufficient_evidence") if refused is None else refused
    most = F.col("max_claims") if max_claims is None else max_claims
    answered = ~refused
    return [
        Rule("query_blank", filled(F.col("query"))),
        Rule("max_claims_range", holds(most.between(1, 100), most)),
        Rule("evidence_missing", at_least(evidence, 1)),
        Rule("evidence_text_blank", each(evidence, lambda e: filled(e["text"]))),
        Rule("evidence_document_not_positive", each(evidence, lambda e: holds(e["document_id"] >= 1))),
        Rule("evidence_id_repeated", unique(evidence["evidence_id"])),
        Rule("chunk_id_repeated", unique(evidence["chunk_id"])),
        Rule("too_many_claims", at_most(claims, most)),
        Rule("refusal_with_claims", when(refused, at_most(claims, 0))),
        Rule("answer_without_claims", when(answered, at_least(claims, 1))),
        Rule("claim_without_evidence", when(answered, each(claims, lambda c: at_least(c["evidence_ids"], 1)))),
        Rule("claim_evidence_repeated", when(answered, each(claims, lambda c: unique(c["evidence_ids"])))),
        Rule("claim_evidence_unknown", when(answered, each(claims, lambda c: within(c["evidence_ids"], evidence["evidence_id"])))),
    ]


def synthesis_rules(claims: Column | None = None, needed: Column | None = None) -> list[Rule]:
    """A synthesis needs two claims and two different pieces of evidence; ``needed`` says which rows are one."""
    claims = F.col("claims") if claims is None else claims
    needed = F.lit(True) if needed is None else needed
    cited = F.array_distinct(F.flatten(claims["evidence_ids"]))
    return [
        Rule("synthesis_claims", when(needed, at_least(claims, 2))),
        Rule("synthesis_evidence", when(needed, at_least(cited, 2))),
    ]


def normal_question(question: Column) -> Column:
    return F.array_join(T.words(question), " ")


def question_rules(question: Column, document_id: Column, shortest: int, longest: int) -> list[Rule]:
    """Rules of a drafted question, on its text with single blanks."""
    folded = T.fold_case(question)
    phrases = F.array(*[F.lit(p) for p in META_PHRASES])
    named = F.filter(phrases, lambda p: F.contains(folded, p))
    return [
        Rule("question_short", holds(F.length(question) >= shortest, F.length(question))),
        Rule("question_long", holds(F.length(question) <= longest, F.length(question))),
        Rule("question_mark_missing", holds(F.endswith(question, F.lit("?")))),
        Rule("question_names_evidence", lacks(question, r"(?iU)\bE\d+\b")),
        Rule("question_names_chunk", lacks(question, "(?i)" + re.escape(":chunk:"))),
        Rule("question_names_document", holds(~F.contains(question, document_id.cast("string")))),
        Rule("question_meta_language", holds(F.size(named) == 0, F.array_join(named, ","))),
    ]


PLAN_PROBLEMS = ["document_not_selected", "document_protected", "chunk_missing", "chunk_of_other_document"]


def resolve_evidence(plans: DataFrame, chunks: DataFrame, selected: DataFrame, protected: DataFrame) -> DataFrame:
    """(plan_id, position, evidence_id, chunk_id, document_id, text, problem), one row per planned chunk.

    ``plans(plan_id, document_id, chunk_ids)`` keep their frozen order as ``position``, so that no list has to
    travel; ``chunks(chunk_id, document_id, text)``, ``selected(document_id)`` and ``protected(document_id)`` are looked up
    by equality. ``problem`` is the first of ``PLAN_PROBLEMS`` that holds, or null. A plan without chunks has
    one row without position, so that its document is still judged.
    """
    allowed = selected.select("document_id").distinct().withColumn("is_selected", F.lit(True))
    barred = protected.select("document_id").distinct().withColumn("is_protected", F.lit(True))
    judged = (
        plans.join(allowed, "document_id", "left").join(barred, "document_id", "left")
        .select("plan_id", "document_id", "is_selected", "is_protected", F.posexplode_outer("chunk_ids").alias("at", "chunk_id"))
    )
    held = chunks.select("chunk_id", F.col("document_id").alias("owner"), "text")
    found = judged.join(held, "chunk_id", "left")
    problem = (
        F.when(F.col("is_selected").isNull(), PLAN_PROBLEMS[0])
        .when(F.col("is_protected").isNotNull(), PLAN_PROBLEMS[1])
        .when(F.col("at").isNotNull() & F.col("owner").isNull(), PLAN_PROBLEMS[2])
        .when(F.col("at").isNotNull() & (F.col("owner") != F.col("document_id")), PLAN_PROBLEMS[3])
    )
    return found.select(
        "plan_id", (F.col("at") + 1).alias("position"), F.concat(F.lit("E"), F.col("at") + 1).alias("evidence_id"), "chunk_id",
        "document_id", "text", problem.alias("problem"),
    )


def resolved_plans(lines: DataFrame) -> DataFrame:
    """(plan_id, document_id, evidence) of the plans all of whose lines resolved; evidence in frozen order, and as
    long as the plan's chunk list. Plans without chunks are left out."""
    evidence = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "evidence_id", "chunk_id", "document_id", "text"))),
        lambda e: F.struct(*[e[f].alias(f) for f in ("evidence_id", "chunk_id", "document_id", "text")]),
    )
    return (
        lines.groupBy("plan_id", "document_id").agg(F.count("problem").alias("problems"), F.count("position").alias("n"), evidence.alias("evidence"))
        .where("problems = 0 AND n > 0").select("plan_id", "document_id", "evidence")
    )
