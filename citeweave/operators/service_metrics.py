"""Latency, status, histogram and reliability summaries of request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.metrics import ratio_or, status_class
from citeweave.operators.scale import exact_quantiles

# Fixed histogram bounds in seconds.
DURATION_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0]


def latency_summary(rows: DataFrame, keys: list[str], value: str, digits: int = 3) -> DataFrame:
    """Count, extremes, mean and exact p50/p95/p99 per key."""
    plain = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("minimum"), F.avg(value).alias("mean"),
        F.max(value).alias("maximum"),
    )
    spread = exact_quantiles(rows, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    names = ["minimum", "mean", "p50", "p95", "p99", "maximum"]
    return plain.join(spread, keys).select(
        *keys, "n", *[F.round(c, digits).alias(f"{c}_ms") for c in names]
    )


def load_report(requests: DataFrame, keys: list[str], wall_seconds: str) -> DataFrame:
    """Status classes, success and refusal rates and request rate per run.

    ``requests(elapsed_ms, status_code, insufficient_evidence)`` plus ``keys``;
    ``wall_seconds`` is an aggregate expression over the run.
    """
    labelled = requests.withColumn("status_class", status_class(F.col("status_code")))

    def hits(label: str):
        return F.count_if(F.col("status_class") == label)

    return labelled.groupBy(*keys).agg(
        F.count("*").alias("request_count"),
        hits("2xx").alias("success_count"), hits("4xx").alias("status_4xx_count"),
        hits("5xx").alias("status_5xx_count"), hits("other").alias("other_status_count"),
        hits("transport_error").alias("transport_error_count"),
        F.count_if((F.col("status_class") == "2xx") & F.col("insufficient_evidence")).alias(
            "insufficient_evidence_count"
        ),
        F.expr(wall_seconds).alias("wall_seconds"),
    ).withColumns(
        {
            "failure_count": F.col("request_count") - F.col("success_count"),
            "success_rate": F.round(F.col("success_count") / F.col("request_count"), 6),
            "refusal_rate": F.round(
                ratio_or(F.col("insufficient_evidence_count"), F.col("success_count"), 0.0), 6
            ),
            "requests_per_second": F.round(F.try_divide(F.col("request_count"), F.col("wall_seconds")), 6),
            "wall_seconds": F.round("wall_seconds", 6),
        }
    )


def request_counters(requests: DataFrame, labels: list[str], seconds: str, buckets=DURATION_BUCKETS) -> DataFrame:
    """Counter plus cumulative duration histogram per label set, long form."""
    counted = requests.groupBy(*labels).agg(
        F.count("*").alias("requests_total"),
        *[F.count_if(F.col(seconds) <= b).alias(f"le_{i}") for i, b in enumerate(buckets)],
        F.count("*").alias(f"le_{len(buckets)}"),
    )
    bounds = [str(b) for b in buckets] + ["+Inf"]
    return counted.select(
        *labels, "requests_total",
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("count")) for i, b in enumerate(bounds)])
        ).alias("h"),
    ).select(*labels, "requests_total", "h.le", F.col("h.count").alias("bucket_count"))


def reliability(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Success, timeout, recovery, refusal and unsafe rates with p50 and p95.

    p95 is the nearest-rank value at ``round(0.95 * (n - 1))``; recovery without
    any attempt counts as 1.0.
    """
    rate = {n: F.round(F.avg(F.col(c).cast("double")), 6).alias(n) for n, c in [
        ("success_rate", "success"), ("timeout_rate", "timed_out"),
        ("safe_refusal_rate", "safe_refusal"), ("unsafe_answer_rate", "unsafe_answer"),
    ]}
    counts = observations.groupBy(*keys).agg(
        F.count("*").alias("request_count"), *rate.values(),
        F.round(
            ratio_or(
                F.count_if(F.col("recovery_attempted") & F.col("recovered")),
                F.count_if(F.col("recovery_attempted")), 1.0,
            ), 6,
        ).alias("recovery_rate"),
    )
    spread = exact_quantiles(
        observations, keys, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95},
        nearest_rank=["p95_latency_ms"],
    )
    return counts.join(spread, keys).withColumn("p50_latency_ms", F.round("p50_latency_ms", 6))


def variant_metrics(observations: DataFrame, key: str = "variant") -> DataFrame:
    """Held-out rates per policy variant."""
    flags = {
        "task_success_rate": "task_success", "refusal_accuracy": "refusal_correct",
        "citation_validity_rate": "citation_valid", "evidence_support_rate": "evidence_supported",
        "tool_selection_accuracy": "tool_selection_correct", "structured_output_rate": "structured_output_valid",
    }
    counts = observations.groupBy(key).agg(
        F.count("*").alias("case_count"),
        *[F.round(F.avg(F.col(c).cast("double")), 6).alias(n) for n, c in flags.items()],
        F.round(F.avg("tool_calls"), 6).alias("mean_tool_calls"),
    )
    spread = exact_quantiles(
        observations, [key], "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95},
        nearest_rank=["p95_latency_ms"],
    )
    return counts.join(spread, key).withColumn("p50_latency_ms", F.round("p50_latency_ms", 6))


def ablation_case_gaps(observations: DataFrame, variants: list[str]) -> DataFrame:
    """Cases not evaluated by every variant."""
    return observations.groupBy("case_id").agg(
        *[F.count_if(F.col("variant") == v).alias(v) for v in variants]
    ).where(" OR ".join(f"`{v}` = 0" for v in variants))


def reward(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Multi-objective reward with its two caps, one row per rollout."""
    w = {
        "supported_answer": 1.0, "refusal_correctness": 1.0, "citation_validity": 1.0, "evidence_support": 1.0,
        "structured_output": 0.25, "tool_selection": 0.5, "unnecessary_tool_penalty": 0.1, **(weights or {}),
    }
    c = F.col

    def part(name: str, condition):
        return F.when(condition, F.lit(w[name])).otherwise(F.lit(0.0)).alias(name)

    scored = rows.select(
        "*",
        part("supported_answer", c("answerable") & c("answered") & c("answer_correct") & c("evidence_supported")),
        part("refusal_correctness", ~c("answerable") & c("refused")),
        part("citation_validity", c("answered") & c("citation_valid")),
        part("evidence_support", c("answered") & c("evidence_supported")),
        part("structured_output", c("structured_output_valid")),
        part("tool_selection", c("required_tool_selected")),
        (F.lit(w["unnecessary_tool_penalty"]) * F.greatest(c("tool_call_count") - c("necessary_tool_calls"), F.lit(0)))
        .alias("unnecessary_tool_penalty"),
    )
    raw = (
        c("supported_answer") + c("refusal_correctness") + c("citation_validity") + c("evidence_support")
        + c("structured_output") + c("tool_selection") - c("unnecessary_tool_penalty")
    )
    asserted = ~c("answerable") & c("answered") & ~c("refused")
    capped = F.when(asserted, F.least(raw, F.lit(0.0))).otherwise(raw)
    total = F.when(
        c("answered") & ~c("citation_valid"), F.least(capped, F.lit(w["structured_output"]))
    ).otherwise(capped)
    return scored.withColumn("total", F.round(total, 6))


def reward_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("count"), F.round(F.avg("total"), 6).alias("mean"),
        F.min("total").alias("minimum"), F.max("total").alias("maximum"),
    )


def throughput(samples: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """Per case: latency summary, token totals and tokens per second."""
    plain = samples.groupBy(key).agg(
        F.count("*").alias("iterations"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.avg("latency_ms"), digits).alias("mean_ms"), F.sum("latency_ms").alias("total_ms"),
    )
    spread = exact_quantiles(samples, [key], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return plain.join(spread, key).select(
        key, "iterations", "output_tokens", "mean_ms", F.round("p50_ms", digits).alias("p50_ms"),
        F.round("p95_ms", digits).alias("p95_ms"),
        F.when(
            (F.col("output_tokens") > 0) & (F.col("total_ms") > 0),
            F.round(F.col("output_tokens") / (F.col("total_ms") / 1000.0), 6),
        ).alias("tokens_per_second"),
    )
