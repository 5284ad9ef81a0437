import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import agents, answer_metrics, calibration, review, scale, service_metrics


@pytest.mark.parametrize("n", [1, 2, 3, 100, 997])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    values = [round(rng.choice([rng.gauss(0, 3), rng.expovariate(0.001), -5.0, 0.0]), 3) for _ in range(n)]
    rows = spark.createDataFrame([("g", v) for v in values], "k string, v double").repartition(3)
    got = scale.exact_quantiles(rows, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.95, "d": 1.0, "nr": 0.95}, ["nr"]).first()
    for name, q in (("a", 0.25), ("b", 0.5), ("c", 0.95), ("d", 1.0)):
        assert got[name] == pytest.approx(float(np.quantile(values, q)), abs=1e-9)
    assert got.nr == sorted(values)[round(0.95 * (n - 1))]


def test_running_totals_and_numbers(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(5)
    got = scale.running_totals(
        rows.withColumn("b", F.floor(F.col("id") / 64)), ["k"], "b", [F.col("id")], {"s": F.col("id")}, {"s": "whole"}
    )
    for r in got.where("id in (0, 5, 700, 998)").collect():
        assert r.s == sum(i for i in range(r.id + 1) if i % 3 == r.k)
        assert r.whole == sum(i for i in range(1000) if i % 3 == r.k)
    numbered = scale.global_row_number(rows, F.floor(F.col("id") / 100), [F.col("id")])
    assert numbered.where("row_no <> id + 1").count() == 0


def test_fits_measures_rows_and_bytes(spark):
    rows = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("t"), F.array(F.lit(1.0)).alias("v"))
    assert scale.fits(rows, 10, 2000) and not scale.fits(rows, 9) and not scale.fits(rows, 10, 900)
    assert not scale.fits(rows, 100, 10_000, per_row=11)


def test_threshold_sweep_against_brute_force(spark):
    rng = random.Random(9)
    pairs = [(round(rng.uniform(-1, 1), 2), rng.random() < 0.4) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "score double, truth boolean").repartition(4)
    scores = sorted({s for s, _ in pairs})
    thresholds = [scores[0] - 1e-6] + [(a + b) / 2 for a, b in zip(scores, scores[1:])] + [scores[-1] + 1e-6]
    want = {}
    for t in thresholds:
        tp = sum(s >= t and y for s, y in pairs)
        fp = sum(s >= t and not y for s, y in pairs)
        fn, tn = sum(y for _, y in pairs) - tp, sum(not y for _, y in pairs) - fp
        recall, spec = tp / (tp + fn), tn / (tn + fp)
        want[round(t, 9)] = (tp, fp, tn, fn, (recall + spec) / 2, tp / (tp + fp) if tp + fp else 0.0, spec, recall, t)
    swept = calibration.sweep(rows)
    got = {round(r.threshold, 9): (r.tp, r.fp, r.tn, r.fn) for r in swept.collect()}
    assert got == {t: v[:4] for t, v in want.items()}
    best = max(want.values(), key=lambda v: (v[4], v[5], v[6], v[8]))
    assert calibration.best_by_precision(swept).first().threshold == pytest.approx(best[8])
    other = max(want.values(), key=lambda v: (v[4], min(v[7], v[6]), v[5]))
    assert calibration.best_by_balance(swept).first().threshold == pytest.approx(other[8])


ANSWER = (
    "query_id string, insufficient_evidence boolean, answer string, claims array<struct<claim_id:string,text:string,citation_ids:array<string>>>, "
    "citations array<struct<citation_id:string,evidence_id:string,chunk_id:string,document_id:bigint,page_start:bigint,page_end:bigint>>, "
    "source_documents array<struct<document_id:bigint,page_ranges:array<string>,chunk_ids:array<string>>>"
)


def test_answer_evaluation(spark):
    answers = spark.createDataFrame(
        [
            ("a", False, "Cool  BATTERY", [("CL1", "t", ["C1"])], [("C1", "E1", "c1", 1, 2, 3)], [(1, ["2-3"], ["c1"])]),
            ("b", False, "x", [("CL1", "t", ["C1", "C9"])], [("C1", "E1", "c1", 1, 2, 2)], [(1, ["3"], ["c1"])]),
            ("c", True, "no", [], [], []),
        ], ANSWER,
    )
    expected = spark.createDataFrame(
        [("a", True, ["battery", "wing"]), ("b", False, []), ("c", False, []), ("d", True, ["z"])],
        "query_id string, expected_answerable boolean, expected_terms array<string>",
    )
    rows = answer_metrics.evaluate_answers(answers, expected)
    got = {r.query_id: r for r in rows.collect()}
    assert got["a"].structurally_valid and got["a"].expected_term_recall == 0.5
    assert not got["b"].structurally_valid and got["b"].source_backed_citation_count == 0
    assert got["c"].structurally_valid and got["d"].generation_failed and got["d"].expected_term_recall == 0.0
    total = answer_metrics.summarize_answers(rows).first()
    assert (total.generation_failure_rate, total.answerability_accuracy, total.unsupported_refusal_rate) == (0.25, 0.5, 0.5)
    assert total.expected_term_recall == pytest.approx(1 / 3, abs=1e-6)
    empty = answer_metrics.summarize_answers(rows.where("query_id = 'c'")).first()
    assert empty.answerable_completion_rate == 1.0 and empty.claim_citation_coverage_rate == 1.0


def test_telemetry_ignores_unknown_calls_of_the_deterministic_kind(spark):
    rows = spark.createDataFrame(
        [("fake", None, True, None), ("remote", True, True, 2), ("remote", False, True, None), ("remote", None, False, None)],
        "provider string, provider_called boolean, expected_answerable boolean, attempts int",
    ).withColumns({c: F.lit(None).cast("bigint") for c in ("input_tokens", "output_tokens")}).withColumns(
        {"estimated_cost_usd": F.lit(None).cast("double"), "latency_seconds": F.col("attempts").cast("double")}
    )
    got = {r.provider: r for r in answer_metrics.provider_telemetry(rows).collect()}
    assert got["fake"].provider_call_unknown_count == 0 and got["fake"].retry_rate is None
    assert (got["remote"].provider_call_unknown_count, got["remote"].policy_accuracy, got["remote"].retry_rate) == (1, 0.5, 1.0)
    assert got["remote"].p95_latency_seconds == 2.0


@pytest.mark.parametrize(
    "flags, total",
    [
        (dict(answerable=True, answered=True, answer_correct=True, citation_valid=True, evidence_supported=True, structured_output_valid=True, required_tool_selected=True), 3.75),
        (dict(answered=True, structured_output_valid=True, required_tool_selected=True, citation_valid=True), 0.0),
        (dict(answerable=True, answered=True, answer_correct=True, evidence_supported=True, structured_output_valid=True), 0.25),
        (dict(refused=True), 1.0),
    ],
)
def test_reward_caps(spark, flags, total):
    names = ["answerable", "answered", "refused", "answer_correct", "citation_valid", "evidence_supported", "structured_output_valid", "required_tool_selected"]
    row = spark.range(1).select(*[F.lit(flags.get(n, False)).alias(n) for n in names], F.lit(2).alias("tool_call_count"), F.lit(2).alias("necessary_tool_calls"))
    assert service_metrics.reward(row).first().total == total


def test_review_flow(spark):
    queue = spark.createDataFrame(
        [("r1", "s", "q", "t1", None), ("r2", "s", "q", "t1", None), ("r3", "t", "q", "t2", None), ("r4", "t", "q", "t3", "PRESENT")],
        "review_id string, system string, query_id string, txt string, automatic_label string",
    )
    pending = queue.where("automatic_label is null")
    units = review.review_units(pending, ["txt"], batch_size=1)
    members = review.unit_members(pending, units, ["txt"])
    assert sorted((r.member_count, r.batch_no) for r in units.collect()) in ([(1, 1), (2, 2)], [(1, 2), (2, 1)])
    decisions = units.select("unit_id", F.when(F.col("member_count") == 2, "ABSENT").otherwise("AMBIGUOUS").alias("human_label"))
    final = {r.review_id: r.final_label for r in review.adjudicate(queue, members, decisions).collect()}
    assert final == {"r1": "ABSENT", "r2": "ABSENT", "r3": "AMBIGUOUS", "r4": "PRESENT"}
    assert review.adjudication_gaps(queue, members, decisions).count() == 0
    assert review.adjudication_gaps(queue, members, decisions.where("human_label = 'ABSENT'")).first().ref == "r3"
    bounds = {r.system: r for r in review.coverage_bounds(review.adjudicate(queue, members, decisions), "system").collect()}
    assert (bounds["t"].micro_lower, bounds["t"].micro_upper) == (0.5, 1.0)


def test_small_agent_rules(spark):
    row = spark.createDataFrame([("Read TIMEOUT",), ("invalid json",), ("connection lost",), ("boom",)], "m string")
    assert [r[0] for r in row.select(agents.failure_class(F.col("m"))).collect()] == [
        "timeout", "malformed_response", "dependency_unavailable", "service_error",
    ]
    budget = agents.retries_allowed(F.lit("hybrid_retrieve"), F.lit("timeout"), {("hybrid_retrieve", "timeout"): 2})
    assert spark.range(1).select(budget).first()[0] == 2
    state = spark.createDataFrame([("approve", "q", "e"), ("edit", "q", "e"), ("reject", "q", "e")], "decision string, current_query string, edited_query string").withColumn("selected_tool", F.lit("t"))
    got = [(r.current_query, r.termination_reason) for r in agents.review_response(state).collect()]
    assert got == [("q", None), ("e", None), ("q", "grounded_refusal")]


def test_regression_and_parity(spark):
    report = spark.createDataFrame([(10, 0.91234, "m")], "query_count int, recall double, generation_model string")
    got = [r.failure for r in answer_metrics.regression_failures(report, {"recall": 0.95}, {"query_count": 12, "generation_model": "m"}).collect()]
    assert got == ["query_count: expected 12, found 10", "recall: found 0.9123, required at least 0.9500"]
    left = spark.createDataFrame([(1, 0.5, "a"), (2, 0.1, None)], "id int, x double, s string")
    right = spark.createDataFrame([(1, 0.5 + 1e-13, "b"), (2, 0.1, None)], "id int, x double, s string")
    assert [(r.id, r.field) for r in answer_metrics.report_mismatches(left, right, "id", ["x", "s"]).collect()] == [(1, "s")]


def test_load_report_and_histogram(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(at + timedelta(seconds=i), s, i % 2 == 0, 0.01 * i) for i, s in enumerate([200, 201, 404, 500, 302, None])],
        "ts timestamp, status_code int, insufficient_evidence boolean, seconds double",
    ).withColumn("run", F.lit(1))
    got = service_metrics.load_report(rows, ["run"], "5.0D").first()
    assert (got.success_count, got.failure_count, got.transport_error_count, got.refusal_rate) == (2, 4, 1, 0.5)
    assert got.requests_per_second == 1.2
    buckets = {r.le: r.bucket_count for r in service_metrics.request_counters(rows, ["run"], "seconds").collect()}
    assert buckets["0.005"] == 1 and buckets["0.01"] == 2 and buckets["+Inf"] == 6
