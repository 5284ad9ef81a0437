"""Receipts of generated plans from their nested call telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.nested import all_known, known_total, known_values
from citeweave.functions.text import words

STAGES = ("question", "verification", "answer")


def _tokens_known(x: Column) -> Column:
    return x["usage"]["input_tokens"].isNotNull() & x["usage"]["output_tokens"].isNotNull()


def accepted(results: DataFrame) -> DataFrame:
    """One receipt per built example.

    ``results(plan_id, example_type, example_id, question_attempts, question_telemetry, verification_telemetry,
    answer_telemetry)``; telemetry elements have ``attempts``, ``request_id``, ``usage(input_tokens, output_tokens)`` and
    ``estimated_cost_usd``. A call counts its tokens only if both numbers are known; a receipt is complete only
    if tokens and cost of all calls are.
    """
    calls = [F.col(f"{s}_telemetry") for s in STAGES]

    def added(name: str) -> Column:
        return reduce(
            lambda a, b: a + b,
            [known_total(c, lambda x: x["usage"][name], "bigint", _tokens_known) for c in calls],
        )

    parts = [lambda x: x["usage"]["input_tokens"], lambda x: x["usage"]["output_tokens"], lambda x: x["estimated_cost_usd"]]
    cost = reduce(lambda a, b: a + b, [known_total(c, lambda x: x["estimated_cost_usd"], "decimal(38,9)") for c in calls])
    complete = reduce(lambda a, b: a & b, [all_known(c, *parts) for c in calls])
    return results.select(
        "plan_id", "example_type", F.lit("accepted").alias("status"), "example_id", F.col("question_attempts").cast("bigint").alias("question_attempts"),
        F.coalesce(F.size(calls[1]), F.lit(0)).cast("bigint").alias("verification_attempts"),
        known_total(calls[2], lambda x: x["attempts"], "bigint").alias("answer_attempts"),
        *[known_values(c, lambda x: x["request_id"]).alias(f"{s}_request_ids") for s, c in zip(STAGES, calls)],
        added("input_tokens").alias("input_tokens"), added("output_tokens").alias("output_tokens"),
        (added("input_tokens") + added("output_tokens")).alias("total_tokens"),
        cost.cast("double").alias("estimated_cost_usd"), complete.alias("telemetry_complete"),
        F.lit(None).cast("string").alias("rejection_reason"),
    )


def unsuccessful(plans: DataFrame) -> DataFrame:
    """Receipts of plans without a result: ``plans(plan_id, example_type, status, reason)``, blanks of the reason collapsed.

    Rows whose status is neither rejected nor failed, or whose reason is blank, are left out; see ``unusable``.
    """
    reason = F.array_join(words(F.col("reason")), " ")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    rows = plans.select("plan_id", "example_type", "status", reason.alias("rejection_reason"))
    return rows.where(F.col("status").isin("rejected", "failed") & (F.length("rejection_reason") > 0)).select(
        "plan_id", "example_type", "status", F.lit(None).cast("string").alias("example_id"),
        *[zero.alias(f"{s}_attempts") for s in STAGES], *[none.alias(f"{s}_request_ids") for s in STAGES],
        *[zero.alias(n) for n in ("input_tokens", "output_tokens", "total_tokens")],
        F.lit(0.0).alias("estimated_cost_usd"), F.lit(False).alias("telemetry_complete"), "rejection_reason",
    )


def unusable(plans: DataFrame) -> DataFrame:
    """(plan_id, problem) of the rows that ``unsuccessful`` leaves out."""
    blank = F.coalesce(F.size(words(F.col("reason"))), F.lit(0)) == 0
    problem = F.when(~F.coalesce(F.col("status").isin("rejected", "failed"), F.lit(False)), "status").when(blank, "reason_blank")
    return plans.select("plan_id", problem.alias("problem")).where("problem IS NOT NULL")
