"""Evaluation of grounded answers, provider telemetry and paired studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions.metrics import provider_kind, success_rate
from citeweave.operators.evidence import page_range
from citeweave.operators.scale import exact_quantiles


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def evaluate_answers(answers: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per-query answerability, citation and term checks.

    ``answers`` carries nested claims/citations/source_documents;
    ``expectations(query_id, expected_answerable, expected_terms)``. A missing
    answer is a failed generation.
    """
    joined = expectations.join(answers, "query_id", "left")
    failed = F.col("insufficient_evidence").isNull()
    references = F.flatten("claims.citation_ids")
    known = F.col("citations.citation_id")

    def backed(c: Column) -> Column:
        return F.exists(
            "source_documents",
            lambda d: (d["document_id"] == c["document_id"])
            & F.array_contains(d["chunk_ids"], c["chunk_id"])
            & F.array_contains(d["page_ranges"], page_range(c["page_start"], c["page_end"])),
        )

    normalized = T.normalize_training_text(F.col("answer"))
    matched = F.filter("expected_terms", lambda t: F.contains(normalized, T.normalize_training_text(t)))

    def counted(value: Column) -> Column:
        return F.when(failed, F.lit(0)).otherwise(value).cast("bigint")

    rows = joined.select(
        "query_id", "expected_answerable",
        (~F.col("insufficient_evidence")).alias("predicted_answerable"),
        failed.alias("generation_failed"),
        counted(F.size("claims")).alias("claim_count"),
        counted(F.size("citations")).alias("citation_count"),
        counted(F.size("source_documents")).alias("source_document_count"),
        counted(F.size(F.filter("claims", lambda c: F.size(c["citation_ids"]) > 0))).alias("cited_claim_count"),
        counted(F.size(references)).alias("total_citation_reference_count"),
        counted(F.size(F.filter(references, lambda r: F.array_contains(known, r)))).alias(
            "valid_citation_reference_count"
        ),
        counted(F.size(F.filter("citations", backed))).alias("source_backed_citation_count"),
        F.size("expected_terms").cast("bigint").alias("expected_term_count"),
        counted(F.size(matched)).alias("matched_term_count"),
    )
    sound = (
        (F.col("claim_count") > 0)
        & (F.col("cited_claim_count") == F.col("claim_count"))
        & (F.col("valid_citation_reference_count") == F.col("total_citation_reference_count"))
        & (F.col("source_backed_citation_count") == F.col("citation_count"))
    )
    bare = (F.col("claim_count") + F.col("citation_count") + F.col("source_document_count")) == 0
    return rows.withColumns(
        {
            "answerability_correct": F.coalesce(
                F.col("predicted_answerable") == F.col("expected_answerable"), F.lit(False)
            ),
            "expected_term_recall": F.when(
                F.col("expected_term_count") > 0, F.col("matched_term_count") / F.col("expected_term_count")
            ),
            "structurally_valid": F.when(F.col("generation_failed"), F.lit(False))
            .when(F.col("predicted_answerable"), sound)
            .otherwise(bare),
        }
    )


RATES = [
    "generation_failure_rate", "answerability_accuracy", "answerable_completion_rate", "unsupported_refusal_rate",
    "claim_citation_coverage_rate", "citation_reference_validity_rate", "source_document_coverage_rate",
    "expected_term_recall", "structural_validity_rate",
]


def summarize_answers(evaluated: DataFrame, keys: list[str] | None = None, digits: int | None = 6) -> DataFrame:
    """All counts and rates in one aggregation; an empty denominator gives 1.0. ``digits`` None leaves rates as they are."""
    done = ~F.col("generation_failed")
    wanted = F.col("expected_answerable")
    given = F.col("predicted_answerable")
    counts = evaluated.groupBy(*(keys or [])).agg(
        F.count("*").alias("query_count"),
        _count(done, "completed_query_count"),
        _count(F.col("generation_failed"), "generation_failure_count"),
        _count(wanted, "answerable_query_count"),
        _count(~wanted, "unanswerable_query_count"),
        _count(given, "predicted_answerable_count"),
        _count(done & ~given, "refusal_count"),
        _count(F.col("answerability_correct"), "correct_answerability_count"),
        _count(done & wanted & given, "completed_answerable_count"),
        _count(done & ~wanted & ~given, "correctly_refused_unanswerable_count"),
        *[
            F.sum(c).alias(f"{n}")
            for c, n in [
                ("claim_count", "total_claim_count"),
                ("cited_claim_count", "cited_claim_total"),
                ("total_citation_reference_count", "citation_reference_total"),
                ("valid_citation_reference_count", "valid_citation_reference_total"),
                ("citation_count", "citation_total"),
                ("source_backed_citation_count", "source_backed_citation_total"),
                ("expected_term_count", "expected_term_total"),
                ("matched_term_count", "matched_term_total"),
            ]
        ],
        _count(F.col("structurally_valid"), "structurally_valid_answer_count"),
    )
    pairs = {
        "generation_failure_rate": ("generation_failure_count", "query_count"),
        "answerability_accuracy": ("correct_answerability_count", "query_count"),
        "answerable_completion_rate": ("completed_answerable_count", "answerable_query_count"),
        "unsupported_refusal_rate": ("correctly_refused_unanswerable_count", "unanswerable_query_count"),
        "claim_citation_coverage_rate": ("cited_claim_total", "total_claim_count"),
        "citation_reference_validity_rate": ("valid_citation_reference_total", "citation_reference_total"),
        "source_document_coverage_rate": ("source_backed_citation_total", "citation_total"),
        "expected_term_recall": ("matched_term_total", "expected_term_total"),
        "structural_validity_rate": ("structurally_valid_answer_count", "query_count"),
    }
    rates = {n: success_rate(F.col(a), F.col(b)) for n, (a, b) in pairs.items()}
    return counts.withColumns(rates if digits is None else {n: F.round(r, digits) for n, r in rates.items()})


def provider_telemetry(rows: DataFrame, kind_key: str = "provider") -> DataFrame:
    """Calls, bypasses, policy accuracy, tokens, cost and latency per provider.

    Unknown calls (null) count only where telemetry is expected, that is for
    every provider kind except the deterministic one.
    """
    staged = rows.withColumn("provider_kind", provider_kind(F.col(kind_key))).withColumn(
        "telemetry_expected", F.col("provider_kind") != "deterministic"
    )
    expected = F.col("telemetry_expected")
    called = F.col("provider_called")
    correct = F.when(expected & called.isNotNull(), called == F.col("expected_answerable"))
    keys = [kind_key, "provider_kind", "telemetry_expected"]
    counts = staged.groupBy(*keys).agg(
        F.count("*").alias("query_count"),
        _count(called, "provider_call_count"),
        _count(expected & ~called, "provider_bypass_count"),
        _count(expected & called.isNull(), "provider_call_unknown_count"),
        F.count(correct).alias("policy_evaluated_count"),
        _count(correct, "policy_correct_count"),
        F.sum(F.coalesce("attempts", F.lit(0))).alias("total_attempts"),
        _count(F.col("attempts") > 1, "retried_call_count"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("total_input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("total_output_tokens"),
        F.round(F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))), 6).alias("total_estimated_cost_usd"),
        F.round(F.avg("latency_seconds"), 6).alias("mean_latency_seconds"),
        F.round(F.avg("input_tokens"), 6).alias("mean_input_tokens"),
    )
    known = F.col("provider_call_count") + F.col("provider_bypass_count")
    rated = counts.withColumns(
        {
            "provider_bypass_rate": F.when(
                expected & (known > 0), F.round(success_rate(F.col("provider_bypass_count"), known), 6)
            ),
            "policy_accuracy": F.when(
                expected & (F.col("policy_evaluated_count") > 0),
                F.round(success_rate(F.col("policy_correct_count"), F.col("policy_evaluated_count")), 6),
            ),
            "retry_rate": F.when(
                expected, F.round(success_rate(F.col("retried_call_count"), F.col("provider_call_count")), 6)
            ),
        }
    )
    spread = exact_quantiles(
        staged, keys, "latency_seconds", {"p50_latency_seconds": 0.5, "p95_latency_seconds": 0.95}
    )
    return rated.join(spread, keys, "left").withColumns(
        {c: F.round(c, 6) for c in ("p50_latency_seconds", "p95_latency_seconds")}
    )


def estimate_cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Price per million tokens; null as soon as a count is missing."""
    return input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price


def condition_deltas(reports: DataFrame, condition: str, treated: str, base: str, metrics: list[str]) -> DataFrame:
    """Treated minus base per metric, rounded once; null when a side is missing."""
    long = reports.select(
        condition,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        ).alias("m"),
    ).select(condition, "m.metric", "m.value")
    wide = long.groupBy("metric").pivot(condition, [treated, base]).agg(F.first("value"))
    return wide.select(
        "metric", F.col(f"`{treated}`").alias("treated"), F.col(f"`{base}`").alias("base"),
        F.round(F.col(f"`{treated}`") - F.col(f"`{base}`"), 6).alias("delta"),
    )


def study_verdict(checks: DataFrame) -> DataFrame:
    """Priority classification of a paired study from its checks."""
    return checks.withColumn(
        "verdict",
        F.when(~F.col("baseline_parity"), "baseline_parity_failed")
        .when(~F.col("integrity_passed"), "integrity_regression")
        .when(~F.col("quality_non_regression_passed"), "quality_regression")
        .when(
            (F.col("successful_recovery_count") >= F.col("minimum_successful_recoveries"))
            & F.col("quality_improvement_observed"),
            "benefit_observed",
        )
        .when(F.col("recovery_trigger_count") == 0, "safe_no_recovery_activated")
        .otherwise("safe_no_measured_benefit"),
    )


HIGHER_IS_SAFE = [
    "claim_citation_coverage_rate", "citation_reference_validity_rate", "source_document_coverage_rate",
    "structural_validity_rate", "unsupported_refusal_rate",
]
QUALITY = ["answerability_accuracy", "answerable_completion_rate", "expected_term_recall"]


def safety_checks(pair: DataFrame) -> DataFrame:
    """Boolean non-regression checks over one row with ``base`` and ``treated`` structs."""
    checks = {f"{m}_not_decreased": F.col(f"treated.{m}") >= F.col(f"base.{m}") for m in HIGHER_IS_SAFE + QUALITY}
    checks["no_generation_failure_increase"] = F.col("treated.generation_failure_rate") <= F.col(
        "base.generation_failure_rate"
    )
    improved = F.lit(False)
    for m in QUALITY:
        improved = improved | (F.col(f"treated.{m}") > F.col(f"base.{m}"))
    integrity = checks["no_generation_failure_increase"]
    for m in HIGHER_IS_SAFE:
        integrity = integrity & checks[f"{m}_not_decreased"]
    for c in ("all_traces_valid", "all_provenance_valid", "all_bounds_respected"):
        integrity = integrity & F.col(c)
    quality = F.lit(True)
    for m in QUALITY:
        quality = quality & checks[f"{m}_not_decreased"]
    return pair.withColumns(
        {
            **checks,
            "quality_improvement_observed": improved,
            "integrity_passed": integrity,
            "quality_non_regression_passed": quality,
        }
    )


def report_mismatches(expected: DataFrame, observed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-wise difference of two reports; floats agree within 1e-12."""

    def long(df: DataFrame, name: str) -> DataFrame:
        kinds = dict(df.dtypes)
        typed = [
            F.struct(
                F.lit(f).alias("field"),
                (F.lit(None) if kinds[f] in ("double", "float") else F.col(f)).cast("string").alias("text"),
                (F.col(f) if kinds[f] in ("double", "float") else F.lit(None)).cast("double").alias("number"),
            )
            for f in fields
        ]
        return df.select(key, F.explode(F.array(*typed)).alias("x")).select(
            key, "x.field", F.struct("x.text", "x.number").alias(name)
        )

    both = long(expected, "want").join(long(observed, "got"), [key, "field"], "full_outer")
    close = F.col("want.number").eqNullSafe(F.col("got.number")) | (
        F.abs(F.col("want.number") - F.col("got.number")) <= 1e-12
    )
    same = F.col("want.text").eqNullSafe(F.col("got.text")) & F.coalesce(close, F.lit(False))
    return both.where(~same).select(key, "field")


def regression_failures(report: DataFrame, minimums: dict[str, float], expected: dict[str, object]) -> DataFrame:
    """Violated identities and minimum metrics, one message per row."""
    identity = [
        F.when(
            ~F.col(name).eqNullSafe(F.lit(value)),
            F.concat(F.lit(f"{name}: expected {value}, found "), F.coalesce(F.col(name).cast("string"), F.lit("null"))),
        )
        for name, value in expected.items()
    ]
    floors = [
        F.when(
            F.col(name) < value,
            F.format_string(f"{name}: found %.4f, required at least {value:.4f}", F.col(name).cast("double")),
        )
        for name, value in minimums.items()
    ]
    found = F.explode_outer(F.array_compact(F.array(*identity, *floors)))
    return report.select(found.alias("failure")).where("failure IS NOT NULL")


# The identities and floors of a regression policy, in the order of its messages.
IDENTITIES = ["query_count", "generation_provider", "generation_model"]
FLOORS = [
    "answerability_accuracy", "answerable_completion_rate", "unsupported_refusal_rate", "claim_citation_coverage_rate",
    "citation_reference_validity_rate", "source_document_coverage_rate", "expected_term_recall", "structural_validity_rate",
]


def policy_failures(reports: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """(key, position, failure): what every report breaks of its policy, in the order of the policy.

    ``reports`` has ``key``, the identities and the rates; ``policies`` has ``key``, ``expected_*`` for the identities and
    ``minimum_*`` for the floors. A policy without report fails once; a rate that is missing or no share fails as such.
    """
    both = policies.join(reports.withColumn("__there", F.lit(True)), key, "left")
    there = F.col("__there").isNotNull()
    kinds = dict(reports.dtypes)

    def shown(column: str, name: str) -> Column:
        text = F.coalesce(F.col(column).cast("string"), F.lit("null"))
        return F.concat(F.lit("'"), text, F.lit("'")) if kinds[name] == "string" else text

    checks = [F.when(~there, F.lit("report: missing"))]
    for name in IDENTITIES:
        message = F.concat(F.lit(f"{name}: expected "), shown(f"expected_{name}", name), F.lit(", found "), shown(name, name))
        checks.append(F.when(there & ~F.col(name).eqNullSafe(F.col(f"expected_{name}")), message))
    for name in FLOORS:
        rate, least = F.col(name).cast("double"), F.col(f"minimum_{name}").cast("double")
        no_share = ~F.coalesce(rate.between(0.0, 1.0), F.lit(False)) | F.isnan(rate)
        checks.append(
            F.when(there & no_share, F.concat(F.lit(f"{name}: no share: "), F.coalesce(rate.cast("string"), F.lit("null"))))
            .when(there & (rate < least), F.format_string(f"{name}: found %.4f, required at least %.4f", rate, least))
        )
    listed = F.posexplode(F.array(*checks)).alias("position", "failure")
    return both.select(key, listed).where("failure IS NOT NULL")
