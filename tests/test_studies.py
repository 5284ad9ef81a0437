"""Closed-book reading, paired study, taxonomy, receipts, timings, prompts and spread samples."""

import json

import pytest
from pyspark.sql import functions as F

from citeweave.functions import nested, prompting
from citeweave.operators import answer_metrics, closed_book, paired_study, receipts, spread, stage_timings, taxonomy

R = closed_book.REFUSAL


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_closed_book_lanes(spark):
    outputs = [
        ('{"answer": " Yes ", "claims": [{"text": "a"}], "insufficient_knowledge": false}', "payload", None),
        ('{"answer": "' + R.upper() + '", "claims": [{"text": "a"}], "insufficient_knowledge": true}', "repaired", None),
        ('{"answer": "' + R + '", "claims": []}', "repaired", None),
        ('{"answer": "' + R + '", "insufficient_knowledge": true}', "payload", None),
        ('{"answer": "' + R + '", "claims": [], "insufficient_knowledge": "yes"}', "corrupt", "flag_missing"),
        ('{"answer": "Other", "claims": []}', "corrupt", "flag_missing"),
        ("Yes.", "corrupt", "not_json"), (None, "corrupt", "not_json"), ('"text"', "corrupt", "not_object"), ("[]", "corrupt", "not_object"),
        ('{"answer": "x", "claims": [], "insufficient_knowledge": true, "url": ""}', "corrupt", "field_unknown"),
        ('{"answer": 3, "claims": [], "insufficient_knowledge": true}', "corrupt", "answer_missing"),
        ('{"answer": " ", "claims": [], "insufficient_knowledge": true}', "corrupt", "answer_missing"),
        ('{"answer": "x", "claims": ["a"], "insufficient_knowledge": false}', "corrupt", "claims_malformed"),
        ('{"answer": "x", "claims": [{"text": "a", "id": 1}], "insufficient_knowledge": false}', "corrupt", "claims_malformed"),
        ('{"answer": "x", "claims": null, "insufficient_knowledge": false}', "corrupt", "claims_malformed"),
        ('{"answer": "x", "claims": [{"text": " "}], "insufficient_knowledge": false}', "corrupt", "claim_blank"),
        ('{"answer": "x", "claims": [{"text": "A  b"}, {"text": "a B"}], "insufficient_knowledge": false}', "corrupt", "claim_repeated"),
        (json.dumps({"answer": "x", "claims": [{"text": str(i)} for i in range(9)], "insufficient_knowledge": False}), "corrupt", "too_many_claims"),
        ('{"answer": "x", "claims": [{"text": "a"}], "insufficient_knowledge": true}', "corrupt", "refusal_with_claims"),
        ('{"answer": "x", "claims": [], "insufficient_knowledge": false}', "corrupt", "answer_without_claims"),
    ]
    rows = spark.createDataFrame([(i, o) for i, (o, _, _) in enumerate(outputs)], "id int, output string")
    got = {r.id: r for r in closed_book.read_payload(rows, "output").collect()}
    assert [(got[i].lane, got[i].category) for i in range(len(outputs))] == [(lane, kind) for _, lane, kind in outputs]
    assert got[0].answer == "Yes" and got[0].claims == ["a"] and got[1].claims == [] and got[2].insufficient_knowledge and got[6].answer is None
    fenced = spark.createDataFrame([('```json\n{"answer": "x", "claims": [{"text": "a"}], "insufficient_knowledge": false}\n```',)], "output string")
    assert closed_book.read_payload(fenced, "output", fenced=True).first().lane == "payload"


def test_closed_book_report(spark):
    good = '{"answer": "The Rocket flew", "claims": [{"text": "a"}, {"text": "b"}], "insufficient_knowledge": false}'
    refusal = json.dumps({"answer": R, "claims": [], "insufficient_knowledge": True})
    rows = [("c", "q1", None, good), ("c", "q2", None, refusal), ("c", "q3", "transport", None), ("c", "q4", None, "broken"), ("c", "q5", None, good), ("c", "q6", "other", good)]
    asked = [("q1", True, ["rocket", "moon"]), ("q2", False, []), ("q3", True, ["x"]), ("q4", False, None), ("q5", False, None), ("q6", True, None)]
    read = closed_book.read_payload(spark.createDataFrame(rows, "condition string, query_id string, error string, output string"), "output")
    evaluated = closed_book.evaluate(read, spark.createDataFrame(asked, "query_id string, expected_answerable boolean, expected_terms array<string>"))
    assert found(evaluated, "query_id", "failure_type", "claim_count", "matched_term_count", "expected_term_recall") == [
        ("q1", None, 2, 1, 0.5), ("q2", None, 0, 0, None), ("q3", "provider_transport", 0, 0, 0.0), ("q4", "response_validation", 0, 0, None),
        ("q5", None, 2, 0, None), ("q6", "unknown", 0, 0, None),
    ]
    r = closed_book.summarize(evaluated).first()
    assert (r.query_count, r.completed_query_count, r.refusal_count, r.unsupported_generation_count, r.false_refusal_count) == (6, 3, 1, 1, 0)
    assert (r.answerable_completion_rate, r.unsupported_refusal_rate, r.expected_term_recall, r.claims_per_answerable_query) == (1 / 3, 1 / 3, 1 / 3, 2 / 3)


STATES = ["retrieve_initial", "assess_initial", "rewrite_query", "retrieve_recovery", "assess_recovery"]


def trace(**change):
    source = {"attempt_number": 1, "chunk_id": "c", "citation_url": "u", "source_url": "s", "document_sha256": "d"}
    attempt = {"attempt_number": 1, "retrieval_query": "q", "returned_evidence_count": 1, "used_evidence_count": 1, "sufficient": False, "provenance": [source]}
    second = {**attempt, "attempt_number": 2, "retrieval_query": "q more", "sufficient": True, "provenance": [{**source, "attempt_number": 2}]}
    row = {
        "query_id": "x", "generation_failed": False, "total_latency_ms": 10.0, "retrieval_ms": 5.0, "evidence_build_ms": 1.0, "original_query": "q",
        "rewritten_query": "q more", "states": [*STATES, "generate"], "attempts": [attempt, second], "terminal_state": "generate",
        "insufficient_evidence": False, "retrieval_attempt_count": 2, "query_rewrite_count": 1,
    }
    row.update(change)
    return row


ANSWER = (
    "query_id string, generation_failed boolean, total_latency_ms double, retrieval_ms double, evidence_build_ms double, original_query string, rewritten_query string, "
    "states array<string>, attempts array<struct<attempt_number:int,retrieval_query:string,returned_evidence_count:int,used_evidence_count:int,sufficient:boolean,"
    "provenance:array<struct<attempt_number:int,chunk_id:string,citation_url:string,source_url:string,document_sha256:string>>>>, terminal_state string, "
    "insufficient_evidence boolean, retrieval_attempt_count int, query_rewrite_count int"
)


def test_traces_follow_the_automaton(spark):
    base = trace()
    one = [{**base["attempts"][0], "sufficient": True}]
    short = {"states": [*STATES[:2], "generate"], "attempts": one, "rewritten_query": None, "retrieval_attempt_count": 1, "query_rewrite_count": 0}
    lost = [{**base["attempts"][0], "provenance": []}, base["attempts"][1]]
    bare = [base["attempts"][0], {**base["attempts"][1], "provenance": [{**base["attempts"][1]["provenance"][0], "source_url": " ", "attempt_number": 1}]}]
    cases = {
        "two passes": ({}, []), "one pass": (short, []), "untimed": ({"retrieval_attempt_count": None, "query_rewrite_count": None}, []),
        "skipped state": ({"states": [*STATES[:2], *STATES[3:], "generate"]}, ["states_and_attempts_differ", "states_broken"]),
        "no end": ({"states": STATES}, ["states_broken"]), "after the end": ({"states": [*STATES, "generate", "generate"]}, ["states_broken"]),
        "rewritten single pass": ({**short, "rewritten_query": "q", "query_rewrite_count": 1}, ["single_pass_rewrites"]),
        "contradiction": ({"insufficient_evidence": True}, ["end_contradicts_answer"]),
        "other query": ({"rewritten_query": "else"}, ["recovery_asks_otherwise"]), "miscounted": ({"retrieval_attempt_count": 1}, ["timings_differ"]),
        "beyond": ({"retrieval_attempt_count": 3, "query_rewrite_count": 2}, ["bound_passes", "bound_rewrites", "timings_differ"]),
        "lost evidence": ({"attempts": lost}, ["provenance_count"]), "bare source": ({"attempts": bare}, ["provenance_attempt", "provenance_source"]),
        "three passes": ({"attempts": [*base["attempts"], {**base["attempts"][1], "attempt_number": 3}], "retrieval_attempt_count": 3},
                         ["bound_passes", "provenance_attempt", "states_and_attempts_differ"]),
    }
    table = spark.createDataFrame([trace(query_id=n, **c) for n, (c, _) in cases.items()], ANSWER)
    got = {}
    for name, check in found(paired_study.trace_violations(table), "query_id", "check_name"):
        got.setdefault(name, []).append(check)
    assert {n: got.get(n, []) for n in cases} == {n: want for n, (_, want) in cases.items()}


def test_diagnostics_and_report(spark):
    rows = [trace(query_id="a"), trace(query_id="b", generation_failed=True), trace(query_id="c", states=None, attempts=None), trace(query_id="d", insufficient_evidence=True)]
    judged = paired_study.diagnostics(spark.createDataFrame(rows, ANSWER)).withColumn("condition", F.lit("adaptive"))
    assert found(judged, "query_id", "missing_trace", "trace_valid", "provenance_valid", "bounds_respected", "recovery_succeeded") == [
        ("a", False, True, True, True, True), ("b", False, None, None, None, False), ("c", True, False, False, False, False), ("d", False, False, True, True, True)
    ]
    r = paired_study.condition_report(judged).first()
    assert (r.total_retrieval_attempts, r.recovery_trigger_count, r.missing_trace_count, r.invalid_trace_count, r.mean_total_latency_ms, r.p95_retrieval_ms) == (6, 2, 1, 2, 10.0, 5.0)
    asked = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "query_id string, expected_answerable boolean")
    assert paired_study.query_set_problems(asked, 1, 2).count() == 0
    assert found(paired_study.query_set_problems(asked, 2, 2), "check_name", "detail") == [("answerable_count", "1"), ("query_count", "3")]


def test_taxonomy(spark):
    names = ["w", "x", "y", "z"]
    rows = [(c, q, f"Question {q}", q, i) for i, (q, c) in enumerate((q, c) for q in (1, 2, 3) for c in names) if (q, c) != (2, "y")]
    rows += [("w", 3, "Question three", 3, 90), ("v", 1, "Question 1", 1, 91)]
    table = spark.createDataFrame(rows, "condition string, query_id int, query string, position int, n int")
    assert found(taxonomy.coverage_gaps(table, names), "query_id", "check_name", "detail") == [
        (1, "condition_unknown", "1"), (2, "condition_missing", "y"), (3, "condition_repeated", "w"), (3, "query_differs", "text")
    ]
    queue = taxonomy.review_queue(table.where("n < 90"), F.floor(F.col("position") / 2))
    assert {(r.query_id, r.unit_id) for r in queue.collect()} == {(q, f"unsuprev_00{q}") for q in (1, 2, 3)}
    labels = taxonomy.LABELS
    good = [(f"{r[0]}:{r[1]}", r[0], r[1], f"unsuprev_00{r[1]}", labels[r[4] % 3], "CONFIRMED", False, "n") for r in rows if r[4] < 90]
    bad = [good[0], ("w:9", "w", 9, "unsuprev_009", "SHRUG", "DRAFT", True, " "), good[1][:3] + ("unsuprev_007",) + good[1][4:]]
    kind = "review_id string, condition string, query_id int, unit_id string, human_label string, decision_status string, confirmation_required boolean, note string"
    decisions = spark.createDataFrame(good[2:] + bad + [good[0]], kind)
    problems = taxonomy.decision_problems(queue, decisions.where("review_id <> 'z:3'"))
    assert found(problems, "review_id", "check_name", "detail") == [
        ("w:1", "decision_repeated", "2"), ("w:9", "confirmation_pending", ""), ("w:9", "decision_extra", ""), ("w:9", "label_unknown", "SHRUG"),
        ("w:9", "not_confirmed", "DRAFT"), ("w:9", "note_blank", ""), ("x:1", "fields_differ", "unit_id"), ("z:3", "decision_missing", ""),
    ]
    final = taxonomy.final_labels(queue, spark.createDataFrame(good, kind), taxonomy.decision_problems(queue, spark.createDataFrame(good, kind)))
    sums = {r.condition: r for r in taxonomy.summary(final).collect()}
    assert sums[None].total == 11 and sum(sums[None][x.lower()] for x in labels) == 11 and sums["y"].total == 2
    (row,) = taxonomy.comparisons(taxonomy.summary(final), [("x", "w")]).collect()
    assert row.safe_non_assertion_rate == round(sums["x"].safe_non_assertion_rate - sums["w"].safe_non_assertion_rate, 6)


def test_receipts_count_what_is_known(spark):
    call = "array<struct<attempts:int,request_id:string,usage:struct<input_tokens:int,output_tokens:int>,estimated_cost_usd:double>>"
    schema = f"plan_id string, example_type string, example_id string, question_attempts int, question_telemetry {call}, verification_telemetry {call}, answer_telemetry {call}"
    rows = [
        ("full", "ordinary", "e", 1, [(1, "a", (10, 1), 0.5)], [], [(2, "b", (20, 2), 0.25), (3, None, (5, 5), 0.0)]),
        ("half", "ordinary", "e", 1, [(1, None, (10, None), None)], [(1, "v", None, 0.5)], None),
    ]
    got = {r.plan_id: r for r in receipts.accepted(spark.createDataFrame(rows, schema)).collect()}
    full, half = got["full"], got["half"]
    assert (full.answer_attempts, full.input_tokens, full.total_tokens, full.estimated_cost_usd, full.telemetry_complete) == (5, 35, 43, 0.75, True)
    assert full.answer_request_ids == ["b"] and (half.input_tokens, half.output_tokens, half.estimated_cost_usd, half.telemetry_complete) == (0, 0, 0.5, False)
    plans = spark.createDataFrame([("p", "o", "failed", " too \n long "), ("q", "o", "rejected", " "), ("r", "o", "accepted", "x")], "plan_id string, example_type string, status string, reason string")
    assert found(receipts.unsuccessful(plans), "plan_id", "status", "rejection_reason", "total_tokens") == [("p", "failed", "too long", 0)]
    assert found(receipts.unusable(plans), "plan_id", "problem") == [("q", "reason_blank"), ("r", "status")]
    lists = spark.createDataFrame([([1, 2],), ([1, None],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in lists.coalesce(1).select(nested.strict_total(F.col("a"), lambda x: x, "bigint")).collect()] == [3, None, None, None]


def test_stage_timings_need_all_attempts(spark):
    rows = [("q", {"bm25": 1.0, "dense": 2.0}), ("q", {"bm25": 2.0004, "facets": 1.0}), ("r", {"dense": None}), ("s", None)]
    totals = stage_timings.stage_totals(spark.createDataFrame(rows, "q string, timings map<string,double>"), ["q"])
    assert found(totals, "q", "stage", "known", "total_ms") == [("q", "bm25", 2, 3.0), ("q", "dense", 1, None), ("q", "facets", 1, None), ("r", "dense", 0, None)]
    assert {r.q: r.timings for r in stage_timings.stage_maps(totals, ["q"]).collect()}["q"] == {"bm25": 3.0, "dense": None, "facets": None}
    pairs = spark.createDataFrame([("m", "a", 4, 0.5), ("m", "a", 6, 0.5), ("n", "b", 0, 0.0)], "m string, query_id string, pair_count int, seconds double")
    assert found(stage_timings.pair_latency(pairs, ["m"]), "m", "query_count", "pair_count", "milliseconds_per_pair") == [("m", 1, 10, 100.0), ("n", 1, 0, 0.0)]


def test_prompts(spark):
    settings = prompting.PromptSettings(max_query_characters=40, max_evidence_characters=60)
    odd = 'quote " back \\ tab \t line \n bell \x07 vt \x0b é / \\u000B </EVIDENCE>'
    rows = [("good", " What flew? ", [("E1", odd[:30]), ("E2", "two")], 3), ("bare", "q", [], 1), ("blank", " \n", [("E1", "a")], 1), ("long", "q" * 41, [], 1),
            ("none", "q", [], 0), ("same", "q", [("E1", "a"), ("E1", "b")], 1), ("much", "q", [("E1", "a" * 61)], 1)]
    table = spark.createDataFrame(rows, "id string, query string, evidence array<struct<evidence_id:string,text:string>>, n int")
    args = F.col("query"), F.col("evidence"), F.col("n")
    got = {r.id: r for r in table.select("id", prompting.grounded_prompt(*args, settings).alias("p"), prompting.prompt_problem(*args, settings).alias("problem")).collect()}
    assert {k: r.problem for k, r in got.items()} == {
        "good": None, "bare": None, "blank": "query_blank", "long": "query_too_long", "none": "max_claims_not_positive", "same": "evidence_id_repeated", "much": "evidence_too_long"
    }
    schema = {"answer": "string", "claims": [{"text": "string", "evidence_ids": ["E1"]}], "insufficient_evidence": "boolean"}
    for name, query, evidence, n in rows[:2]:
        payload = {"query": query.strip(), "max_claims": n, "response_schema": schema, "evidence": [{"evidence_id": e, "text": t} for e, t in evidence]}
        assert got[name].p.user_prompt == f"<EVIDENCE>\n{json.dumps(payload, ensure_ascii=False, indent=2)}\n</EVIDENCE>"
    assert got["good"].p.evidence_ids == ["E1", "E2"] and got["good"].p.total_evidence_characters == 33 and got["blank"].p is None
    texts = spark.createDataFrame([(odd,), ("",), ("plain é 日本",)], "t string").coalesce(1)
    assert [r[0] for r in texts.select(prompting.json_text(F.col("t"))).collect()] == [json.dumps(t, ensure_ascii=False) for t in (odd, "", "plain é 日本")]
    held = spark.createDataFrame([([("E1", odd)],)], "evidence array<struct<evidence_id:string,text:string>>")
    user = held.select(prompting.grounded_prompt(F.lit("q"), F.col("evidence"), F.lit(1)).alias("p")).first().p.user_prompt
    assert user.count("</EVIDENCE>") == 1 and json.loads(user.removeprefix("<EVIDENCE>").removesuffix("</EVIDENCE>"))["evidence"][0]["text"] == odd
    cut = table.where("id = 'good'").select(prompting.within_budget(F.col("evidence"), 31).alias("e")).first().e
    assert [e.evidence_id for e in cut] == ["E1"]
    for bad in ({"start_marker": "a", "end_marker": "a"}, {"max_query_characters": 0}):
        with pytest.raises(ValueError):
            prompting.PromptSettings(**bad)


@pytest.mark.parametrize("count", [1, 2, 7, 99, 100, 101])
def test_spread_takes_the_same_rows_as_a_sort(spark, count):
    rows = [(f"x{i}", i * i % 37) for i in range(100)]
    table = spark.createDataFrame(rows, "id string, size int").repartition(6)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert found(spread.select_spread(table, "size", "id", count), "id", "size") == sorted((ordered[i] for i in spread.wanted_ranks(100, count)), key=repr)
    assert spread.wanted_ranks(6, 4) == [0, 2, 3, 5] and spread.wanted_ranks(5, 1) == [2] and spread.wanted_ranks(0, 3) == []


def test_policy_lists_every_failure_in_order(spark):
    rates = {m: 0.9 for m in answer_metrics.FLOORS}
    reports = [("good", 10, "p", "m", *rates.values()), ("bad", 9, "q", None, *{**rates, "expected_term_recall": 0.5, "structural_validity_rate": 1.5}.values())]
    named = ["id", *answer_metrics.IDENTITIES, *answer_metrics.FLOORS]
    table = spark.createDataFrame(reports, ", ".join(f"{n} {k}" for n, k in zip(named, ["string", "long", "string", "string"] + ["double"] * 8, strict=True)))
    wanted = ["id", *[f"expected_{n}" for n in answer_metrics.IDENTITIES], *[f"minimum_{n}" for n in answer_metrics.FLOORS]]
    policies = spark.createDataFrame([(i, 10, "p", "m", *rates.values()) for i in ("good", "bad", "gone")], wanted)
    assert found(answer_metrics.policy_failures(table, policies, "id"), "id", "position", "failure") == [
        ("bad", 1, "query_count: expected 10, found 9"), ("bad", 10, "expected_term_recall: found 0.5000, required at least 0.9000"),
        ("bad", 11, "structural_validity_rate: no share: 1.5"), ("bad", 2, "generation_provider: expected 'p', found 'q'"),
        ("bad", 3, "generation_model: expected 'm', found 'null'"), ("gone", 0, "report: missing"),
    ]
