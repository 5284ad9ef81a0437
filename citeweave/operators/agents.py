"""Agent trajectories: retry rules, reviews, checkpoints and trajectory metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.metrics import ratio_or
from citeweave.operators.scale import exact_quantiles

REFUSAL_REASONS = [
    "grounded_refusal", "insufficient_evidence", "unrecoverable_tool_failure", "citation_validation_failure",
]


def failure_class(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(F.contains(low, F.lit("timeout")), "timeout")
        .when(F.contains(low, F.lit("malformed")) | F.contains(low, F.lit("invalid")), "malformed_response")
        .when(F.contains(low, F.lit("unavailable")) | F.contains(low, F.lit("connection")), "dependency_unavailable")
        .otherwise("service_error")
    )


def retries_allowed(tool: Column, failure: Column, policy: dict[tuple[str, str], int]) -> Column:
    """Retry budget of (tool, failure class), zero when unlisted."""
    if not policy:
        return F.lit(0)
    table = F.create_map(*[x for (t, f), n in policy.items() for x in (F.lit(f"{t}|{f}"), F.lit(n))])
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", tool, failure)), F.lit(0))


def review_response(rows: DataFrame) -> DataFrame:
    """Apply approve / reject / edit to a state waiting for review.

    Approval and edits clear the terminal state; an edit also replaces the
    current query; a rejection ends in a grounded refusal.
    """
    resumed = F.col("decision").isin("approve", "edit")
    return rows.withColumns(
        {
            "current_query": F.when(F.col("decision") == "edit", F.col("edited_query")).otherwise(
                F.col("current_query")
            ),
            "termination_reason": F.when(resumed, F.lit(None).cast("string")).otherwise("grounded_refusal"),
            "human_review_required": F.lit(False),
            "selected_tool": F.when(resumed, F.lit(None).cast("string")).otherwise(F.col("selected_tool")),
        }
    )


def trajectory_metrics(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Behaviour, recovery and efficiency rates over (case, run) rows."""
    keys = keys or []
    c = F.col
    used = F.array_distinct("tools_used")
    required = F.array_distinct("required_tools")
    covered = F.size(F.array_intersect(required, used))
    clean = ~F.arrays_overlap("forbidden_tools", "tools_used")
    clean = F.coalesce(clean, F.lit(True))
    refused = c("termination_reason").isin(*REFUSAL_REASONS)
    completed = F.when(
        c("answerable"), (c("termination_reason") == "answer_completed") & c("answered")
    ).otherwise(refused | (c("termination_reason") == "human_review_required"))

    def rate(condition: Column, name: str) -> Column:
        return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 6).alias(name)

    counts = observations.groupBy(*keys).agg(
        F.count("*").alias("case_count"),
        rate(completed, "task_completion_rate"),
        rate(c("termination_reason").eqNullSafe(c("expected_termination")), "termination_accuracy"),
        rate((covered == F.size(required)) & clean, "tool_selection_accuracy"),
        F.round(ratio_or(F.sum(covered), F.sum(F.size(required)), 1.0), 6).alias("required_tool_recall"),
        rate(clean, "forbidden_tool_avoidance"),
        rate(F.size("tools_used") <= c("maximum_tool_calls"), "tool_budget_compliance"),
        F.round(
            ratio_or(F.count_if(~c("answerable") & refused), F.count_if(~c("answerable")), 1.0), 6
        ).alias("safe_refusal_accuracy"),
        rate(c("retry_count") > 0, "retry_case_rate"),
        F.round(
            ratio_or(
                F.count_if((c("retry_count") > 0) & c("recovered_after_failure")),
                F.count_if(c("retry_count") > 0), 1.0,
            ), 6,
        ).alias("recovery_success_rate"),
        rate(c("human_review_triggered"), "human_review_trigger_rate"),
        F.round(F.avg(F.size("tools_used")), 6).alias("mean_tool_calls"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
    )
    spread = exact_quantiles(
        observations, keys, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95},
        nearest_rank=["p95_latency_ms"],
    )
    if keys:
        return counts.join(spread, keys)
    return counts.withColumns(
        {n: spread.select(n).scalar() for n in ("p50_latency_ms", "p95_latency_ms")}
    )


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Newest checkpoint row per thread, combined map-side."""
    rest = [c for c in checkpoints.columns if c != "thread_id"]
    return checkpoints.groupBy("thread_id").agg(F.max_by(F.struct(*rest), "sequence").alias("r")).select(
        "thread_id", *[F.col(f"r.{c}").alias(c) for c in rest]
    )


def safe_outcome(retrieved: DataFrame, generated: DataFrame) -> DataFrame:
    """Distributed request outcome: refuse without evidence or where ``generated(request_id, cited_evidence_ids,
    refused)`` says so; fail where no response arrived or it cites unknown evidence."""
    joined = retrieved.join(generated, "request_id", "left")
    unknown = F.size(F.array_except("cited_evidence_ids", "evidence_ids")) > 0
    return joined.select(
        "request_id",
        F.when(F.size("evidence_ids") == 0, "grounded_refusal")
        .when(F.col("cited_evidence_ids").isNull(), "dependency_failure")
        .when(F.col("refused"), "grounded_refusal")
        .when(unknown, "citation_validation_failure")
        .otherwise("answer_completed").alias("termination_reason"),
    )
