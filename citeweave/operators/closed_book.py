"""Closed-book answers: tolerant reading of model output, then counts, rates and telemetry per condition.

Output is read once as a variant. A sound payload passes; the one refusal shape that models get wrong, the fixed
refusal sentence with claims or without its flag, is repaired; everything else is corrupt and has a category. All three
are rows with the same columns, so nothing stops a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.metrics import success_rate
from citeweave.functions.text import normalize_training_text, strip, strip_code_fence
from citeweave.operators.scale import exact_quantiles

# Fixed value: the sentence of a refusal.
REFUSAL = "I do not have sufficient reliable knowledge to answer this question."
FIELDS = ["answer", "claims", "insufficient_knowledge"]
MOST_CLAIMS = 8


def _kind(payload: Column, path: str) -> Column:
    """Type name of a part of a variant; null if it is not there."""
    return F.schema_of_variant(F.try_variant_get(payload, path, "variant"))


def read_payload(rows: DataFrame, output: str, fenced: bool = False) -> DataFrame:
    """``rows`` with lane (payload, repaired or corrupt), category, answer, claims and insufficient_knowledge.

    ``fenced`` also takes output inside a code fence. Categories: not_json, not_object, field_unknown, answer_missing,
    claims_malformed, flag_missing, claim_blank, claim_repeated, too_many_claims, refusal_with_claims,
    answer_without_claims.
    """
    text = strip_code_fence(F.col(output)) if fenced else F.col(output)
    parsed = rows.withColumn("__v", F.try_parse_json(text)).withColumn(
        "__keys", F.when(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), F.map_keys(F.try_variant_get("__v", "$", "map<string,variant>")))
    )
    v = F.col("__v")
    items = F.try_variant_get(v, "$.claims", "array<variant>")
    answer = F.when(_kind(v, "$.answer") == "STRING", strip(F.try_variant_get(v, "$.answer", "string")))
    flag = F.when(_kind(v, "$.insufficient_knowledge") == "BOOLEAN", F.try_variant_get(v, "$.insufficient_knowledge", "boolean"))
    sound_items = F.forall(items, lambda c: F.schema_of_variant(c) == "OBJECT<text: STRING>")
    texts = F.transform(items, lambda c: strip(F.try_variant_get(c, "$.text", "string")))
    listed = F.array_contains("__keys", "claims")
    none = F.array().cast("array<string>")
    read = parsed.select(
        *rows.columns, "__keys", v.isNull().alias("__unread"), answer.alias("answer"), flag.alias("__flag"),
        (listed & ~F.coalesce(sound_items, F.lit(False))).alias("__odd"), F.coalesce(texts, none).alias("__claims"),
    )
    refusal = F.coalesce(normalize_training_text(F.col("answer")) == normalize_training_text(F.lit(REFUSAL)), F.lit(False))
    unflagged = ~F.array_contains("__keys", "insufficient_knowledge")
    repair = refusal & (unflagged | (F.col("__flag") & ((F.size("__claims") > 0) | F.col("__odd"))))
    fixed = read.withColumn("__repair", F.coalesce(repair, F.lit(False)))
    fixed = fixed.select(
        *[c for c in fixed.columns if c not in ("__flag", "__claims", "__odd")],
        F.when(F.col("__repair"), F.lit(True)).otherwise(F.col("__flag")).alias("insufficient_knowledge"),
        F.when(F.col("__repair"), none).otherwise(F.col("__claims")).alias("claims"), (F.col("__odd") & ~F.col("__repair")).alias("__odd"),
    )
    normal = F.transform("claims", normalize_training_text)
    category = (
        F.when(F.col("__unread"), "not_json")
        .when(F.col("__keys").isNull(), "not_object")
        .when(F.size(F.array_except("__keys", F.array(*[F.lit(f) for f in FIELDS]))) > 0, "field_unknown")
        .when(F.coalesce(F.length("answer"), F.lit(0)) == 0, "answer_missing")
        .when(F.col("__odd"), "claims_malformed")
        .when(F.col("insufficient_knowledge").isNull(), "flag_missing")
        .when(F.exists("claims", lambda c: F.length(c) == 0), "claim_blank")
        .when(F.size("claims") > MOST_CLAIMS, "too_many_claims")
        .when(F.size(F.array_distinct(normal)) < F.size("claims"), "claim_repeated")
        .when(F.col("insufficient_knowledge") & (F.size("claims") > 0), "refusal_with_claims")
        .when(~F.col("insufficient_knowledge") & (F.size("claims") == 0), "answer_without_claims")
    )
    judged = fixed.withColumn("category", category)
    usable = F.col("category").isNull()
    return judged.select(
        *rows.columns, F.when(~usable, "corrupt").when(F.col("__repair"), "repaired").otherwise("payload").alias("lane"), "category",
        F.when(usable, F.col("answer")).alias("answer"), F.when(usable, F.col("claims")).alias("claims"),
        F.when(usable, F.col("insufficient_knowledge")).alias("insufficient_knowledge"),
    )


def failure_type(error: Column, category: Column) -> Column:
    """Kind of a failed generation: what the transport said, or an output that broke the contract."""
    return (
        F.when(error == "transport", "provider_transport").when(error.isNotNull(), "unknown")
        .when(category.isNotNull(), "response_validation")
    )


def evaluate(read: DataFrame, expectations: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """One row per condition and question.

    ``read`` is ``read_payload`` of rows (keys, query_id, error); ``expectations(query_id, expected_answerable,
    expected_terms)``. Terms are found in the normalized answer.
    """
    joined = read.join(expectations, "query_id")
    kind = failure_type(F.col("error"), F.col("category"))
    failed = kind.isNotNull()
    predicted = F.when(~failed, ~F.col("insufficient_knowledge"))
    answer = normalize_training_text(F.when(~failed, F.col("answer")))
    terms = F.coalesce("expected_terms", F.array().cast("array<string>"))
    matched = F.filter(terms, lambda t: F.coalesce(F.contains(answer, normalize_training_text(t)), F.lit(False)))
    return joined.select(
        *keys, "query_id", "expected_answerable", predicted.alias("predicted_answerable"),
        F.coalesce(predicted == F.col("expected_answerable"), F.lit(False)).alias("answerability_correct"),
        F.coalesce(F.when(~failed, F.col("answer")), F.lit("")).alias("answer"), failed.alias("generation_failed"), kind.alias("failure_type"),
        F.when(~failed, F.size("claims")).otherwise(0).cast("bigint").alias("claim_count"),
        F.size(terms).cast("bigint").alias("expected_term_count"), F.size(matched).cast("bigint").alias("matched_term_count"),
        F.when(F.size(terms) > 0, F.size(matched) / F.size(terms)).alias("expected_term_recall"), (~failed).alias("structurally_valid"),
    )


def summarize(evaluated: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """All counts and rates of a condition in one aggregation; an empty denominator gives 1.0."""

    def n(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    done, wanted, given = ~F.col("generation_failed"), F.col("expected_answerable"), F.col("predicted_answerable")
    claims = F.col("claim_count")
    counts = evaluated.groupBy(*keys).agg(
        F.count("*").alias("query_count"), n(done).alias("completed_query_count"), n(~done).alias("generation_failure_count"),
        n(wanted).alias("answerable_query_count"), n(~wanted).alias("unanswerable_query_count"),
        n(given).alias("predicted_answerable_count"), n(done & ~given).alias("refusal_count"),
        n(F.col("answerability_correct")).alias("correct_answerability_count"),
        n(done & wanted & given).alias("completed_answerable_count"), n(done & ~wanted & ~given).alias("correctly_refused_unanswerable_count"),
        n(wanted & ~given).alias("false_refusal_count"), n(~wanted & given).alias("unsupported_generation_count"),
        F.sum(claims).alias("total_claim_count"), F.sum(F.when(wanted, claims).otherwise(0)).alias("answerable_claim_count"),
        F.sum(F.when(~wanted, claims).otherwise(0)).alias("unanswerable_claim_count"),
        F.sum("expected_term_count").alias("expected_term_count"), F.sum("matched_term_count").alias("matched_expected_term_count"),
        n(F.col("structurally_valid")).alias("structurally_valid_answer_count"),
    )
    rates = {
        "generation_failure_rate": ("generation_failure_count", "query_count"),
        "answerability_accuracy": ("correct_answerability_count", "query_count"),
        "answerable_completion_rate": ("completed_answerable_count", "answerable_query_count"),
        "unsupported_refusal_rate": ("correctly_refused_unanswerable_count", "unanswerable_query_count"),
        "expected_term_recall": ("matched_expected_term_count", "expected_term_count"),
        "structural_validity_rate": ("structurally_valid_answer_count", "query_count"),
        "claims_per_answerable_query": ("answerable_claim_count", "answerable_query_count"),
    }
    return counts.withColumns({name: success_rate(F.col(a), F.col(b)) for name, (a, b) in rates.items()})


def telemetry(calls: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Tokens and latency per condition from ``calls(keys, generation_failed, latency_seconds, input_tokens, output_tokens,
    total_tokens)``; unknown and failed calls' tokens count as 0."""

    def tokens(name: str) -> Column:
        return F.sum(F.when(F.col("generation_failed"), 0).otherwise(F.coalesce(name, F.lit(0)))).alias(f"total_{name.removeprefix('total_')}")

    sums = calls.groupBy(*keys).agg(
        F.count("*").alias("query_count"), F.count_if(~F.col("generation_failed")).alias("successful_call_count"),
        *[tokens(c) for c in ("input_tokens", "output_tokens", "total_tokens")], F.avg("latency_seconds").alias("mean_latency_seconds"),
    )
    spread = exact_quantiles(calls, keys, "latency_seconds", {"p50_latency_seconds": 0.5, "p95_latency_seconds": 0.95})
    return sums.join(spread, list(keys), "left")
