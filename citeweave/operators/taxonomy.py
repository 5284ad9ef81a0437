"""Taxonomy of the answers that several conditions gave to unanswerable questions.

Responses are rows (condition, query_id, query, position, answer, ...). A review queue has one row per condition and
question; confirmed decisions label them. Whatever does not fit is a row of its own and labels nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.integrity import all_of
from citeweave.operators.scale import global_row_number

# The labels of the taxonomy.
LABELS = ["EXPLICIT_REFUSAL", "CORRECTIVE_DENIAL", "UNSUPPORTED_ASSERTION", "STRUCTURAL_FAILURE"]


def first_match(table: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Ordered decision table: the label of the first condition that is true."""
    out = F.lit(otherwise)
    for label, condition in reversed(table):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def proposed_label(denial: Column) -> Column:
    """A label from what a response says about itself, for reviewers to confirm; ``denial`` marks corrective wording."""
    return first_match(
        [
            ("STRUCTURAL_FAILURE", F.col("generation_failed") | ~F.col("structurally_valid")),
            ("EXPLICIT_REFUSAL", ~F.col("predicted_answerable")),
            ("CORRECTIVE_DENIAL", denial),
        ],
        "UNSUPPORTED_ASSERTION",
    )


def coverage_gaps(responses: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """(query_id, check_name, detail): questions that are not answered exactly once, and alike, in every condition.

    One aggregation per question takes the place of an outer join of all conditions.
    """
    seen = responses.groupBy("query_id").agg(
        *[F.count_if(F.col("condition") == c).alias(f"n{i}") for i, c in enumerate(conditions)],
        F.count_if(~F.col("condition").isin(*conditions) | F.col("condition").isNull()).alias("other"),
        F.min("query").alias("low"), F.max("query").alias("high"),
    )

    def named(test) -> Column:
        return F.concat_ws(",", *[F.when(test(F.col(f"n{i}")), F.lit(c)) for i, c in enumerate(conditions)])

    checks = F.array(
        F.struct(F.lit("condition_missing").alias("check_name"), named(lambda n: n == 0).alias("detail")),
        F.struct(F.lit("condition_repeated").alias("check_name"), named(lambda n: n > 1).alias("detail")),
        F.struct(F.lit("condition_unknown").alias("check_name"), F.when(F.col("other") > 0, F.col("other").cast("string")).otherwise("").alias("detail")),
        F.struct(F.lit("query_differs").alias("check_name"), F.when(F.col("low") != F.col("high"), "text").otherwise("").alias("detail")),
    )
    return seen.select("query_id", F.explode(checks).alias("c")).where("c.detail <> ''").select("query_id", "c.check_name", "c.detail")


def review_queue(responses: DataFrame, position_bucket: Column) -> DataFrame:
    """The responses with unit and review ids. Units are numbered by ``position``, then id, over all questions;
    ``position_bucket`` grows with the position and cuts the numbering into parts."""
    units = responses.groupBy("query_id").agg(F.min("position").alias("position"))
    numbered = global_row_number(units, position_bucket, [F.col("position"), F.col("query_id")], "unit_no")
    unit = F.concat(F.lit("unsuprev_"), F.when(F.col("unit_no") < 1000, F.lpad(F.col("unit_no").cast("string"), 3, "0")).otherwise(F.col("unit_no").cast("string")))
    return responses.join(numbered.select("query_id", unit.alias("unit_id")), "query_id").withColumn(
        "review_id", F.concat_ws(":", "condition", F.col("query_id").cast("string"))
    )


def decision_problems(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """(review_id, check_name, detail) of decisions that cannot be used and of responses without one.

    ``decisions(review_id, condition, query_id, unit_id, human_label, decision_status, confirmation_required, note)``.
    """
    fields = ["condition", "query_id", "unit_id"]
    asked = queue.select("review_id", *[F.col(f).alias(f"queue_{f}") for f in fields]).distinct()
    both = asked.withColumn("asked", F.lit(True)).join(decisions.withColumn("decided", F.lit(True)), "review_id", "full")
    differing = F.concat_ws(",", *[F.when(~F.col(f).eqNullSafe(F.col(f"queue_{f}")), F.lit(f)) for f in fields])
    decided, matched = F.col("decided").isNotNull(), F.col("asked").isNotNull() & F.col("decided").isNotNull()
    tests = [
        ("decision_missing", F.col("decided").isNull(), F.lit("")),
        ("decision_extra", F.col("asked").isNull(), F.lit("")),
        ("label_unknown", decided & ~F.coalesce(F.col("human_label").isin(*LABELS), F.lit(False)), F.coalesce("human_label", F.lit(""))),
        ("not_confirmed", decided & ~F.col("decision_status").eqNullSafe("CONFIRMED"), F.coalesce("decision_status", F.lit(""))),
        ("confirmation_pending", decided & ~F.col("confirmation_required").eqNullSafe(False), F.lit("")),
        ("note_blank", decided & (F.length(F.trim(F.coalesce("note", F.lit("")))) == 0), F.lit("")),
        ("fields_differ", matched & (differing != ""), differing),
    ]
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(n).alias("check_name"), d.alias("detail"))) for n, t, d in tests]))
    flaws = both.select("review_id", F.explode(found).alias("f")).select("review_id", "f.check_name", "f.detail")
    repeated = decisions.groupBy("review_id").agg(F.count("*").alias("n")).where("n > 1")
    return all_of(flaws, repeated.select("review_id", F.lit("decision_repeated").alias("check_name"), F.col("n").cast("string").alias("detail")))


def final_labels(queue: DataFrame, decisions: DataFrame, problems: DataFrame) -> DataFrame:
    """The queue with ``final_label`` and its source, for the responses whose decision has no problem."""
    usable = decisions.join(problems.select("review_id").distinct(), "review_id", "left_anti")
    return queue.join(usable.select("review_id", F.col("human_label").alias("final_label"), F.col("note").alias("final_note")), "review_id").withColumn(
        "decision_source", F.concat(F.lit("adjudication:"), "unit_id")
    )


def summary(labelled: DataFrame) -> DataFrame:
    """Counts and rates per condition, and over all conditions (``condition`` null)."""

    def n(label: str) -> Column:
        return F.count_if(F.col("final_label") == label)

    def rate(value: Column) -> Column:
        return F.round(value / F.count("*"), 6)

    return labelled.groupingSets([[F.col("condition")], []], F.col("condition")).agg(
        F.count("*").alias("total"), *[n(x).alias(x.lower()) for x in LABELS],
        rate(n(LABELS[0]) + n(LABELS[1])).alias("safe_non_assertion_rate"), rate(n(LABELS[2])).alias("unsupported_assertion_rate"),
        rate(n(LABELS[3])).alias("structural_failure_rate"),
    ).where("total > 0")


def comparisons(summaries: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(comparison, rate differences) of condition a minus condition b for each of ``pairs``."""
    rates = ["safe_non_assertion_rate", "unsupported_assertion_rate"]
    wanted = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    sides = summaries.where("condition IS NOT NULL").select("condition", *rates, F.explode(wanted).alias("p"))
    return sides.where((F.col("condition") == F.col("p.a")) | (F.col("condition") == F.col("p.b"))).groupBy(
        F.concat_ws(" minus ", "p.a", "p.b").alias("comparison")
    ).agg(*[
        F.round(F.max(F.when(F.col("condition") == F.col("p.a"), F.col(r))) - F.max(F.when(F.col("condition") == F.col("p.b"), F.col(r))), 6).alias(r)
        for r in rates
    ])
