"""Registered queries of studies: receipts, timings, closed-book answers, taxonomies, traces, prompts and spread samples.

Orders, lines, events and conversation turns stand for the records that a run leaves behind; faults are planted by
remainders of their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import prompting
from citeweave.operators import answer_metrics, closed_book, paired_study, receipts, spread, stage_timings, taxonomy
from citeweave.plans import sql as S
from citeweave.plans import tables as P
from citeweave.plans.registry import query
from citeweave.session import stored

_PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_ORDER = "ORDER BY " + ", ".join(_PLACE)


def _lists(lines: DataFrame, **columns: Column) -> DataFrame:
    """(order, arrays) of the lines of an order, seven or so, in line order; null elements left out."""
    held = F.array_sort(F.collect_list(F.struct(*_PLACE, *[c.alias(f"v_{n}") for n, c in columns.items()])))
    rows = lines.groupBy("l_orderkey").agg(held.alias("rows"))
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), *[F.filter(F.col("rows")[f"v_{n}"], lambda x: x.isNotNull()).alias(n) for n in columns])


# --- receipts ----------------------------------------------------------------

_CALL_SQL = """c AS (SELECT *, ['question', 'verification', 'answer'][1 + l_suppkey % 3] AS stage,
      CASE WHEN l_suppkey % 5 <> 0 THEN 'r' || l_suppkey END AS rid, l_discount <> 0.1 AND l_tax <> 0.0 AS tokens, l_quantity <> 50 AS priced FROM lineitem)"""


@query(
    "accepted_receipts",
    f"""WITH {_CALL_SQL} SELECT o_orderkey AS plan_id, 'ordinary' AS example_type, 'accepted' AS status, 'x' || o_orderkey AS example_id,
        count(l_orderkey) FILTER (WHERE stage = 'question') AS question_attempts, count(l_orderkey) FILTER (WHERE stage = 'verification') AS verification_attempts,
        coalesce(sum(l_linenumber) FILTER (WHERE stage = 'answer'), 0)::BIGINT AS answer_attempts,
        {', '.join(f"coalesce(string_agg(rid, ',' {_ORDER}) FILTER (WHERE stage = '{s}'), '') AS {s}_request_ids" for s in receipts.STAGES)},
        coalesce(sum(l_partkey) FILTER (WHERE tokens), 0)::BIGINT AS input_tokens, coalesce(sum(l_suppkey) FILTER (WHERE tokens), 0)::BIGINT AS output_tokens,
        coalesce(sum(l_partkey + l_suppkey) FILTER (WHERE tokens), 0)::BIGINT AS total_tokens,
        coalesce(sum(l_extendedprice::DECIMAL(18, 2)) FILTER (WHERE priced), 0)::DOUBLE AS estimated_cost_usd,
        coalesce(bool_and(tokens AND priced), true) AS telemetry_complete, NULL::VARCHAR AS rejection_reason
        FROM orders LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def accepted_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of all orders; a line is one call of the stage that its supplier tells."""
    usage = F.when(F.col("l_discount") != 0.1, F.struct(
        F.col("l_partkey").alias("input_tokens"), F.when(F.col("l_tax") != 0.0, F.col("l_suppkey")).alias("output_tokens")
    ))
    call = F.struct(
        F.col("l_linenumber").alias("attempts"), F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("r"), "l_suppkey")).alias("request_id"),
        usage.alias("usage"), F.when(F.col("l_quantity") != 50, F.col("l_extendedprice")).alias("estimated_cost_usd"),
    )
    stages = {f"{s}_telemetry": F.when(F.col("l_suppkey") % 3 == i, call) for i, s in enumerate(receipts.STAGES)}
    results = P.table(spark, sf_dir, "orders").select("o_orderkey").join(_lists(P.table(spark, sf_dir, "lineitem"), **stages), "o_orderkey", "left")
    rows = results.select(
        F.col("o_orderkey").alias("plan_id"), F.lit("ordinary").alias("example_type"), F.concat(F.lit("x"), "o_orderkey").alias("example_id"),
        F.coalesce(F.size("question_telemetry"), F.lit(0)).alias("question_attempts"), *stages,
    )
    return receipts.accepted(rows).withColumns({f"{s}_request_ids": F.array_join(f"{s}_request_ids", ",") for s in receipts.STAGES})


@query(
    "unsuccessful_receipts",
    """SELECT event_id AS plan_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'rejected' END AS status, 'k ' || json_extract_string(props, '$.k') AS rejection_reason,
       NULL::VARCHAR AS problem FROM events WHERE event_type IN ('error', 'view') AND json_extract_string(props, '$.k')::BIGINT % 10 <> 0
       UNION ALL SELECT event_id, NULL, NULL, CASE WHEN event_type IN ('error', 'view') THEN 'reason_blank' ELSE 'status' END FROM events
       WHERE event_type NOT IN ('error', 'view') OR json_extract_string(props, '$.k')::BIGINT % 10 = 0""",
)
def unsuccessful_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    plans = P.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("plan_id"), F.lit("ordinary").alias("example_type"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "rejected").otherwise("accepted").alias("status"),
        F.when(k.cast("bigint") % 10 == 0, " \t").otherwise(F.concat(F.lit(" k \n"), k)).alias("reason"),
    )
    none = F.lit(None).cast("string")
    good = receipts.unsuccessful(plans).select("plan_id", "status", "rejection_reason", none.alias("problem"))
    return good.unionByName(receipts.unusable(plans).select("plan_id", none.alias("status"), none.alias("rejection_reason"), "problem"))


# --- timings -----------------------------------------------------------------

_ATTEMPT_SQL = """a AS (SELECT user_id, event_type, value AS bm25_ms, CASE WHEN user_id % 3 = 0 AND event_type = 'error' THEN NULL ELSE value END AS dense_ms,
      CASE WHEN user_id % 5 = 0 THEN NULL ELSE 2 * value END AS hybrid_fusion_ms, value AS reranker_scoring_ms, CASE WHEN k % 50 = 0 THEN NULL ELSE value END AS facet_overhead_ms,
      k AS retrieval_search_count, CASE WHEN user_id % 4 = 0 AND event_type = 'view' THEN NULL ELSE k END AS facet_search_count,
      CASE WHEN user_id % 6 = 0 THEN NULL ELSE k > 97 END AS facet_used FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""


def timed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as retrieval attempts of the question with the user's number."""
    user, kind, value = F.col("user_id"), F.col("event_type"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return P.table(spark, sf_dir, "events").select(
        "user_id", "event_type", value.alias("bm25_ms"), F.when(~((user % 3 == 0) & (kind == "error")), value).alias("dense_ms"),
        F.when(user % 5 != 0, 2 * value).alias("hybrid_fusion_ms"), value.alias("reranker_scoring_ms"), F.when(k % 50 != 0, value).alias("facet_overhead_ms"),
        k.alias("retrieval_search_count"), F.when(~((user % 4 == 0) & (kind == "view")), k).alias("facet_search_count"),
        F.when(user % 6 != 0, k > 97).alias("facet_used"),
    )


@query(
    "attempt_timings",
    f"""WITH {_ATTEMPT_SQL} SELECT user_id, count(*) AS attempts,
        {', '.join(f"CASE WHEN count({c}) = count(*) THEN round(sum({c}), 3) END AS {c}" for c in stage_timings.SUMS)},
        {', '.join(f"CASE WHEN count({c}) = count(*) THEN sum({c})::BIGINT END AS {c}" for c in stage_timings.COUNTS)},
        CASE WHEN count(facet_used) = count(*) THEN bool_or(facet_used) END AS facet_used FROM a GROUP BY 1""",
)
def attempt_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_timings.combined_attempts(timed_attempts(spark, sf_dir), ["user_id"])


@query(
    "stage_totals",
    f"""WITH {_ATTEMPT_SQL}, e AS (SELECT user_id, unnest(['bm25', 'facets', event_type]) AS stage, unnest([bm25_ms, facet_overhead_ms, dense_ms]) AS ms FROM a),
        n AS (SELECT user_id, count(*) AS attempts FROM a GROUP BY 1)
      SELECT user_id, stage, attempts, count(ms) AS known, CASE WHEN count(ms) = attempts THEN round(sum(ms), 3) END AS total_ms FROM e JOIN n USING (user_id) GROUP BY user_id, stage, attempts""",
)
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed_attempts(spark, sf_dir)
    maps = F.create_map(F.lit("bm25"), F.col("bm25_ms"), F.lit("facets"), F.col("facet_overhead_ms"), F.col("event_type"), F.col("dense_ms"))
    return stage_timings.stage_totals(rows.select("user_id", maps.alias("timings")), ["user_id"])


@query(
    "pair_latency",
    f"""WITH {_ATTEMPT_SQL} SELECT event_type, count(DISTINCT user_id) AS query_count, sum(retrieval_search_count)::BIGINT AS pair_count, round(sum(bm25_ms), 6) AS total_seconds,
        round(coalesce(sum(bm25_ms) * 1000.0 / nullif(sum(retrieval_search_count), 0), 0), 6) AS milliseconds_per_pair FROM a GROUP BY 1""",
)
def pair_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed_attempts(spark, sf_dir).select(
        "event_type", F.col("user_id").alias("query_id"), F.col("retrieval_search_count").alias("pair_count"), F.col("bm25_ms").alias("seconds")
    )
    return stage_timings.pair_latency(rows, ["event_type"])


# --- closed book -------------------------------------------------------------

_OUTPUTS = [  # A stands for the answer text, R for the refusal sentence
    '{"answer": "A", "claims": [{"text": "A b"}, {"text": "c"}], "insufficient_knowledge": false}',
    '{"answer": " R", "claims": [{"text": "A"}, 5], "insufficient_knowledge": true}',
    '{"answer": "R", "claims": [{"text": "A"}]}',
    "plain A",
    '{"answer": 5, "claims": [], "insufficient_knowledge": true}',
    '{"answer": "x A", "claims": [{"text": "A", "evidence_ids": []}], "insufficient_knowledge": false}',
    '{"answer": "x A", "claims": [{"text": "A"}], "insufficient_knowledge": true}',
    '{"answer": "x A", "insufficient_knowledge": false}',
    '{"answer": "x A", "claims": [{"text": "A  b"}, {"text": "a B"}, {"text": "A b"}], "insufficient_knowledge": false}',
    '{"answer": "x A", "claims": [{"text": " "}], "insufficient_knowledge": false}',
    '{"answer": "x A", "claims": [{"text": "A"}], "insufficient_knowledge": false, "citations": []}',
    "[1]",
    '{"answer": "Not known: A", "claims": [], "insufficient_knowledge": true}',
    '{"answer": "x A", "claims": "A", "insufficient_knowledge": false}',
]
_LETTERS = "trim(regexp_replace(substr(text, 1, 80), '[^A-Za-z ]+', '', 'g'))"
_BOOK_SQL = f"""o AS (SELECT conv_id || '/' || turn AS query_id, role AS condition, turn % 2 = 0 AS expected_answerable, {_LETTERS} AS a,
      CASE WHEN conv_id % 17 = 0 THEN 'transport' WHEN conv_id % 19 = 0 THEN 'boom' END AS error,
      replace(replace([{', '.join("'" + t + "'" for t in _OUTPUTS)}][1 + (conv_id + turn) % {len(_OUTPUTS)}], 'A', {_LETTERS}), 'R', '{closed_book.REFUSAL}') AS output
      FROM conversations WHERE NOT contains({_LETTERS}, 'R')),
    j AS (SELECT *, list_filter(list_slice(string_split(a, ' '), 1, 2), lambda t: t <> '') || ['zzz'] AS terms,
      CASE WHEN json_valid(output) THEN output::JSON END AS v FROM o),
    k AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) END AS keys,
      CASE WHEN json_type(v, '$.answer') = 'VARCHAR' THEN trim(json_extract_string(v, '$.answer')) END AS answer,
      CASE WHEN json_type(v, '$.insufficient_knowledge') = 'BOOLEAN' THEN json_extract_string(v, '$.insufficient_knowledge') = 'true' END AS flag,
      json_extract(v, '$.claims[*]') AS items FROM j),
    m AS (SELECT *, list_contains(keys, 'claims') AND (json_type(v, '$.claims') <> 'ARRAY' OR
        len(list_filter(items, lambda c: json_type(c) <> 'OBJECT' OR json_keys(c) <> ['text'] OR json_type(c, '$.text') <> 'VARCHAR')) > 0) AS odd,
      coalesce(CASE WHEN json_type(v, '$.claims') = 'ARRAY' THEN list_transform(items, lambda c: trim(coalesce(CASE WHEN json_type(c) = 'OBJECT' THEN json_extract_string(c, '$.text') END, ''))) END, []) AS texts FROM k),
    r AS (SELECT *, coalesce({S.training('answer')} = {S.training(f"'{closed_book.REFUSAL}'")} AND (NOT list_contains(keys, 'insufficient_knowledge') OR (flag AND (len(texts) > 0 OR odd))), false) AS repaired FROM m),
    f AS (SELECT * EXCLUDE (flag, texts, odd), CASE WHEN repaired THEN true ELSE flag END AS flag, CASE WHEN repaired THEN [] ELSE texts END AS texts, odd AND NOT repaired AS odd FROM r),
    g AS (SELECT *, CASE WHEN v IS NULL THEN 'not_json' WHEN keys IS NULL THEN 'not_object'
        WHEN len(list_filter(keys, lambda x: x NOT IN ('answer', 'claims', 'insufficient_knowledge'))) > 0 THEN 'field_unknown'
        WHEN coalesce(answer, '') = '' THEN 'answer_missing' WHEN odd THEN 'claims_malformed' WHEN flag IS NULL THEN 'flag_missing'
        WHEN list_contains(texts, '') THEN 'claim_blank' WHEN len(texts) > 8 THEN 'too_many_claims'
        WHEN len(list_distinct(list_transform(texts, lambda t: lower(trim(regexp_replace(t, ' +', ' ', 'g')))))) < len(texts) THEN 'claim_repeated'
        WHEN flag AND len(texts) > 0 THEN 'refusal_with_claims' WHEN NOT flag AND len(texts) = 0 THEN 'answer_without_claims' END AS category FROM f),
    e AS (SELECT condition, query_id, expected_answerable, category, CASE WHEN category IS NOT NULL THEN 'corrupt' WHEN repaired THEN 'repaired' ELSE 'payload' END AS lane,
        CASE WHEN error = 'transport' THEN 'provider_transport' WHEN error IS NOT NULL THEN 'unknown' WHEN category IS NOT NULL THEN 'response_validation' END AS failure_type,
        answer, texts, terms, flag FROM g),
    w AS (SELECT condition, query_id, lane, category, expected_answerable, failure_type, failure_type IS NOT NULL AS failed,
        CASE WHEN failure_type IS NULL THEN NOT flag END AS given, CASE WHEN failure_type IS NULL THEN len(texts) ELSE 0 END AS claims, len(terms) AS wanted_terms,
        CASE WHEN failure_type IS NULL THEN len(list_filter(terms, lambda t: contains({S.training('answer')}, lower(t)))) ELSE 0 END AS matched FROM e)"""


def closed_book_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model outputs of the condition with the speaker's name."""
    letters = F.trim(F.regexp_replace(F.substring("text", 1, 80), "[^A-Za-z ]+", ""))
    number = F.col("conv_id") + F.col("turn")
    template = F.element_at(F.array(*[F.lit(t) for t in _OUTPUTS]), (1 + number % len(_OUTPUTS)).cast("int"))
    rows = P.table(spark, sf_dir, "conversations").where(~F.contains(letters, F.lit("R"))).select(
        F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.col("role").alias("condition"), (F.col("turn") % 2 == 0).alias("expected_answerable"),
        F.concat(F.filter(F.slice(F.split(letters, " "), 1, 2), lambda t: t != ""), F.array(F.lit("zzz"))).alias("expected_terms"),
        F.when(F.col("conv_id") % 17 == 0, "transport").when(F.col("conv_id") % 19 == 0, "boom").alias("error"),
        F.replace(F.replace(template, F.lit("A"), letters), F.lit("R"), F.lit(closed_book.REFUSAL)).alias("output"),
    )
    return closed_book.read_payload(rows, "output")


def closed_book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = closed_book_reads(spark, sf_dir)
    asked = read.select("query_id", "expected_answerable", "expected_terms")
    return closed_book.evaluate(read.drop("expected_answerable", "expected_terms"), asked)


@query("closed_book_lanes", f"WITH {_BOOK_SQL} SELECT query_id, lane, category, len(texts)::BIGINT AS claims FROM (SELECT query_id, lane, category, CASE WHEN category IS NULL THEN texts END AS texts FROM e)")
def closed_book_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = F.when(F.col("claims").isNotNull(), F.size("claims")).cast("bigint")
    return closed_book_reads(spark, sf_dir).select("query_id", "lane", "category", claims.alias("claims"))


@query(
    "closed_book_answers",
    f"WITH {_BOOK_SQL} SELECT condition, query_id, given AS predicted_answerable, coalesce(given = expected_answerable, false) AS answerability_correct, failure_type, claims::BIGINT AS claim_count, matched::BIGINT AS matched_term_count, matched / wanted_terms AS expected_term_recall FROM w",
)
def closed_book_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_book_rows(spark, sf_dir).select(
        "condition", "query_id", "predicted_answerable", "answerability_correct", "failure_type", "claim_count", "matched_term_count", "expected_term_recall"
    )


_BOOK_RATES = {
    "generation_failure_rate": ("generation_failure_count", "query_count"), "answerability_accuracy": ("correct_answerability_count", "query_count"),
    "answerable_completion_rate": ("completed_answerable_count", "answerable_query_count"),
    "unsupported_refusal_rate": ("correctly_refused_unanswerable_count", "unanswerable_query_count"),
    "expected_term_recall": ("matched_expected_term_count", "expected_term_count"),
    "structural_validity_rate": ("structurally_valid_answer_count", "query_count"), "claims_per_answerable_query": ("answerable_claim_count", "answerable_query_count"),
}


@query(
    "closed_book_report",
    f"""WITH {_BOOK_SQL}, c AS (SELECT condition, count(*) AS query_count, count_if(NOT failed)::BIGINT AS completed_query_count, count_if(failed)::BIGINT AS generation_failure_count,
        count_if(expected_answerable)::BIGINT AS answerable_query_count, count_if(NOT expected_answerable)::BIGINT AS unanswerable_query_count, count_if(given)::BIGINT AS predicted_answerable_count,
        count_if(NOT given)::BIGINT AS refusal_count, count_if(given = expected_answerable)::BIGINT AS correct_answerability_count, count_if(expected_answerable AND given)::BIGINT AS completed_answerable_count,
        count_if(NOT expected_answerable AND NOT given)::BIGINT AS correctly_refused_unanswerable_count, count_if(expected_answerable AND NOT given)::BIGINT AS false_refusal_count,
        count_if(NOT expected_answerable AND given)::BIGINT AS unsupported_generation_count, sum(claims)::BIGINT AS total_claim_count,
        sum(CASE WHEN expected_answerable THEN claims ELSE 0 END)::BIGINT AS answerable_claim_count, sum(CASE WHEN expected_answerable THEN 0 ELSE claims END)::BIGINT AS unanswerable_claim_count,
        sum(wanted_terms)::BIGINT AS expected_term_count, sum(matched)::BIGINT AS matched_expected_term_count, count_if(NOT failed)::BIGINT AS structurally_valid_answer_count FROM w GROUP BY 1)
      SELECT *, {', '.join(f"coalesce({a} / nullif({b}, 0), 1.0)::DOUBLE AS {n}" for n, (a, b) in _BOOK_RATES.items())} FROM c""",
)
def closed_book_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_book.summarize(closed_book_rows(spark, sf_dir))


@query(
    "closed_book_telemetry",
    """SELECT event_type AS condition, count(*) AS query_count, count_if(user_id % 4 <> 0)::BIGINT AS successful_call_count,
       sum(CASE WHEN user_id % 4 = 0 OR k % 3 = 0 THEN 0 ELSE k END)::BIGINT AS total_input_tokens, sum(CASE WHEN user_id % 4 = 0 THEN 0 ELSE k + 1 END)::BIGINT AS total_output_tokens,
       sum(CASE WHEN user_id % 4 = 0 OR k % 3 = 0 THEN 0 ELSE 2 * k + 1 END)::BIGINT AS total_tokens, round(avg(value), 9) AS mean_latency_seconds,
       round(quantile_cont(value, 0.5), 9) AS p50_latency_seconds, round(quantile_cont(value, 0.95), 9) AS p95_latency_seconds
       FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""",
)
def closed_book_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    calls = P.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("condition"), (F.col("user_id") % 4 == 0).alias("generation_failed"), F.col("value").alias("latency_seconds"),
        F.when(k % 3 != 0, k).alias("input_tokens"), (k + 1).alias("output_tokens"), F.when(k % 3 != 0, 2 * k + 1).alias("total_tokens"),
    )
    found = closed_book.telemetry(calls)
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.endswith("latency_seconds")})


# --- taxonomy ----------------------------------------------------------------

CONDITIONS = ["base_closed_book", "tuned_closed_book", "base_rag", "tuned_rag"]
PAIRS = [(CONDITIONS[1], CONDITIONS[0]), (CONDITIONS[2], CONDITIONS[0]), (CONDITIONS[3], CONDITIONS[1])]
_LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in [*taxonomy.LABELS, "OTHER"]) + "]"
_TAXONOMY_SQL = f"""res AS (SELECT CASE WHEN l_linenumber <= 4 THEN [{', '.join(f"'{c}'" for c in CONDITIONS)}][l_linenumber] ELSE 'other' END AS condition, o_orderkey AS query_id,
      o_orderpriority || CASE WHEN l_tax = 0.08 THEN '?' ELSE '' END AS query, l_partkey AS part, l_discount, l_returnflag
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_linenumber <= 5),
    q AS (SELECT condition, query_id, 'unsuprev_' || CASE WHEN no < 1000 THEN lpad(no::VARCHAR, 3, '0') ELSE no::VARCHAR END AS unit_id, condition || ':' || query_id AS review_id, part
      FROM (SELECT *, dense_rank() OVER (ORDER BY query_id) AS no FROM (SELECT condition, query_id, min(part) AS part FROM res WHERE condition <> 'other' GROUP BY ALL))),
    d AS (SELECT review_id, condition, query_id, CASE WHEN part % 37 = 0 THEN 'unsuprev_000' ELSE unit_id END AS unit_id, {_LABEL_SQL}[1 + (part // 4) % 5] AS human_label,
        CASE WHEN part % 23 = 0 THEN 'DRAFT' ELSE 'CONFIRMED' END AS status, part % 29 = 0 AS pending, CASE WHEN part % 31 = 0 THEN ' ' ELSE 'seen' END AS note, part FROM q WHERE part % 11 <> 0),
    dec AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE part % 43 = 0 UNION ALL SELECT 'extra:' || review_id, condition, query_id, unit_id, human_label, status, pending, note, part FROM d WHERE part % 41 = 0),
    bad AS (SELECT review_id, 'decision_missing' AS check_name, '' AS detail FROM q ANTI JOIN dec USING (review_id)
      UNION ALL SELECT review_id, 'decision_extra', '' FROM dec ANTI JOIN q USING (review_id) UNION ALL SELECT review_id, 'label_unknown', human_label FROM dec WHERE human_label = 'OTHER'
      UNION ALL SELECT review_id, 'not_confirmed', status FROM dec WHERE status <> 'CONFIRMED' UNION ALL SELECT review_id, 'confirmation_pending', '' FROM dec WHERE pending
      UNION ALL SELECT review_id, 'note_blank', '' FROM dec WHERE trim(note) = ''
      UNION ALL SELECT review_id, 'fields_differ', 'unit_id' FROM dec JOIN q USING (review_id) WHERE dec.unit_id <> q.unit_id
      UNION ALL SELECT review_id, 'decision_repeated', count(*)::VARCHAR FROM dec GROUP BY 1 HAVING count(*) > 1),
    fin AS (SELECT q.condition, human_label AS label FROM q JOIN dec USING (review_id) WHERE review_id NOT IN (SELECT review_id FROM bad)),
    sums AS (SELECT condition, count(*) AS total, {', '.join(f"count_if(label = '{x}')::BIGINT AS {x.lower()}" for x in taxonomy.LABELS)},
        round((count_if(label = 'EXPLICIT_REFUSAL') + count_if(label = 'CORRECTIVE_DENIAL')) / count(*), 6) AS safe_non_assertion_rate,
        round(count_if(label = 'UNSUPPORTED_ASSERTION') / count(*), 6) AS unsupported_assertion_rate, round(count_if(label = 'STRUCTURAL_FAILURE') / count(*), 6) AS structural_failure_rate
      FROM fin GROUP BY GROUPING SETS ((condition), ()))"""


def taxonomy_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of open orders as responses to the order; the line number tells the condition."""
    named = F.coalesce(F.try_element_at(F.array(*[F.lit(c) for c in CONDITIONS]), F.col("l_linenumber")), F.lit("other"))
    lines = P.table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").withColumnRenamed("l_orderkey", "o_orderkey")
    return P.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(lines, "o_orderkey").select(
        named.alias("condition"), F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("position"),
        F.concat("o_orderpriority", F.when(F.col("l_tax") == 0.08, "?").otherwise("")).alias("query"), F.col("l_partkey").alias("part"),
        (F.col("l_discount") == 0.1).alias("generation_failed"), (F.col("l_discount") < 0.09).alias("structurally_valid"),
        (F.col("l_returnflag") == "A").alias("predicted_answerable"), F.col("l_returnflag").alias("answer"),
    )


def taxonomy_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = taxonomy_responses(spark, sf_dir).where("condition <> 'other'").groupBy("condition", "query_id", "position").agg(F.min("part").alias("part"))
    return stored(taxonomy.review_queue(once, F.floor(F.col("position") / 4096)))


def taxonomy_decisions(queue: DataFrame) -> DataFrame:
    part = F.col("part")
    label = F.element_at(F.array(*[F.lit(x) for x in [*taxonomy.LABELS, "OTHER"]]), (1 + F.floor(part / 4) % 5).cast("int"))
    made = queue.where(part % 11 != 0).select(
        "review_id", "condition", "query_id", F.when(part % 37 == 0, "unsuprev_000").otherwise(F.col("unit_id")).alias("unit_id"), label.alias("human_label"),
        F.when(part % 23 == 0, "DRAFT").otherwise("CONFIRMED").alias("decision_status"), (part % 29 == 0).alias("confirmation_required"),
        F.when(part % 31 == 0, " ").otherwise("seen").alias("note"), "part",
    )
    extra = made.where(part % 41 == 0).withColumn("review_id", F.concat(F.lit("extra:"), "review_id"))
    return made.unionByName(made.where(part % 43 == 0)).unionByName(extra).drop("part")


@query(
    "taxonomy_proposals",
    f"""WITH {_TAXONOMY_SQL} SELECT condition, CASE WHEN l_discount >= 0.09 THEN 'STRUCTURAL_FAILURE' WHEN l_returnflag <> 'A' THEN 'EXPLICIT_REFUSAL'
        WHEN contains(query, '?') THEN 'CORRECTIVE_DENIAL' ELSE 'UNSUPPORTED_ASSERTION' END AS label, count(*) AS n FROM res GROUP BY ALL""",
)
def taxonomy_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = taxonomy.proposed_label(F.contains("query", F.lit("?")))
    return taxonomy_responses(spark, sf_dir).groupBy("condition", label.alias("label")).agg(F.count("*").alias("n"))


@query(
    "taxonomy_gaps",
    f"""WITH {_TAXONOMY_SQL}, n AS (SELECT query_id, unnest([{', '.join(f"'{c}'" for c in CONDITIONS)}]) AS condition, unnest([1, 2, 3, 4]) AS pos FROM (SELECT DISTINCT query_id FROM res)),
        m AS (SELECT query_id, condition, pos, count(part) AS n FROM n LEFT JOIN res USING (query_id, condition) GROUP BY ALL)
      SELECT query_id, 'condition_missing' AS check_name, string_agg(condition, ',' ORDER BY pos) AS detail FROM m WHERE n = 0 GROUP BY 1
      UNION ALL SELECT query_id, 'condition_repeated', string_agg(condition, ',' ORDER BY pos) FROM m WHERE n > 1 GROUP BY 1
      UNION ALL SELECT query_id, 'condition_unknown', count(*)::VARCHAR FROM res WHERE condition = 'other' GROUP BY 1
      UNION ALL SELECT query_id, 'query_differs', 'text' FROM res GROUP BY 1 HAVING count(DISTINCT query) > 1""",
)
def taxonomy_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.coverage_gaps(taxonomy_responses(spark, sf_dir), CONDITIONS)


@query("taxonomy_decision_problems", f"WITH {_TAXONOMY_SQL} SELECT * FROM bad")
def taxonomy_decision_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = taxonomy_queue(spark, sf_dir)
    return taxonomy.decision_problems(queue, taxonomy_decisions(queue))


def taxonomy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = taxonomy_queue(spark, sf_dir)
    decisions = stored(taxonomy_decisions(queue))
    return taxonomy.summary(taxonomy.final_labels(queue, decisions, taxonomy.decision_problems(queue, decisions)))


@query("taxonomy_summary", f"WITH {_TAXONOMY_SQL} SELECT * FROM sums")
def taxonomy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy_summaries(spark, sf_dir)


@query(
    "taxonomy_comparisons",
    f"""WITH {_TAXONOMY_SQL} SELECT a.condition || ' minus ' || b.condition AS comparison, round(a.safe_non_assertion_rate - b.safe_non_assertion_rate, 6) AS safe_non_assertion_rate,
        round(a.unsupported_assertion_rate - b.unsupported_assertion_rate, 6) AS unsupported_assertion_rate FROM sums a, sums b
        WHERE (a.condition, b.condition) IN ({', '.join(f"('{a}', '{b}')" for a, b in PAIRS)})""",
)
def taxonomy_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.comparisons(stored(taxonomy_summaries(spark, sf_dir)), PAIRS)


# --- prompts and spread samples ----------------------------------------------

_SETTINGS = prompting.PromptSettings(max_query_characters=900, max_evidence_characters=1500)
_SCHEMA_SQL = '{\n    "answer": "string",\n    "claims": [\n      {\n        "text": "string",\n        "evidence_ids": [\n          "E1"\n        ]\n      }\n    ],\n    "insufficient_evidence": "boolean"\n  }'


@query(
    "grounded_prompts",
    f"""WITH t AS (SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS asked, conv_id % 4 AS most,
          coalesce(list({{'id': 'E' || (turn // CASE WHEN conv_id % 9 = 0 THEN 4 ELSE 1 END), 'text': text || CASE WHEN turn % 3 = 1 THEN ' </EVIDENCE> "q" ' || chr(9) || chr(92) ELSE '' END}} ORDER BY turn)
            FILTER (WHERE role <> 'user'), []) AS ev FROM conversations GROUP BY conv_id),
        u AS (SELECT *, {S.strip('asked')} AS q, coalesce(list_sum(list_transform(ev, lambda e: length(e.text))), 0)::BIGINT AS used FROM t),
        p AS (SELECT *, CASE WHEN coalesce(q, '') = '' THEN 'query_blank' WHEN length(q) > 900 THEN 'query_too_long' WHEN most < 1 THEN 'max_claims_not_positive'
          WHEN len(list_distinct(list_transform(ev, lambda e: e.id))) < len(ev) THEN 'evidence_id_repeated' WHEN used > 1500 THEN 'evidence_too_long' END AS problem FROM u)
      SELECT conv_id, problem, CASE WHEN problem IS NULL THEN used END AS evidence_characters,
        CASE WHEN problem IS NULL THEN '<EVIDENCE>' || chr(10) || replace('{{' || chr(10) || '  "query": ' || to_json(q) || ',' || chr(10) || '  "max_claims": ' || most || ',' || chr(10)
          || '  "response_schema": {_SCHEMA_SQL},' || chr(10) || '  "evidence": ' || CASE WHEN len(ev) = 0 THEN '[]' ELSE '[' || chr(10) || array_to_string(list_transform(ev, lambda e:
            '    {{' || chr(10) || '      "evidence_id": ' || to_json(e.id) || ',' || chr(10) || '      "text": ' || to_json(e.text) || chr(10) || '    }}'), ',' || chr(10)) || chr(10) || '  ]' END
          || chr(10) || '}}', '</EVIDENCE>', '\\u003c/EVIDENCE>') || chr(10) || '</EVIDENCE>' END AS user_prompt FROM p""",
)
def grounded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question of each conversation with its answers as evidence."""
    turn = F.col("turn")
    part = F.floor(turn / F.when(F.col("conv_id") % 9 == 0, 4).otherwise(1))
    text = F.concat("text", F.when(turn % 3 == 1, ' </EVIDENCE> "q" \t\\').otherwise(""))
    evidence = F.struct(F.concat(F.lit("E"), part).alias("evidence_id"), text.alias("text"))
    rows = P.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", turn)).alias("asked"),
        F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct(turn, evidence.alias("e")))))["e"].alias("evidence"),
    )
    most = F.col("conv_id") % 4
    built = prompting.grounded_prompt(F.col("asked"), F.col("evidence"), most, _SETTINGS)
    problem = prompting.prompt_problem(F.col("asked"), F.col("evidence"), most, _SETTINGS)
    return rows.select("conv_id", problem.alias("problem"), built.alias("p")).select(
        "conv_id", "problem", F.col("p.total_evidence_characters").cast("bigint").alias("evidence_characters"), F.col("p.user_prompt").alias("user_prompt")
    )


@query(
    "spread_sample",
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
       w AS (SELECT round_even(unnest(range(100)) * (n - 1) / 99.0, 0)::BIGINT AS pos FROM (SELECT count(*) AS n FROM documents))
       SELECT doc_id, n_chars FROM r WHERE n <= 100 OR pos IN (SELECT pos FROM w)""",
)
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents from the shortest to the longest."""
    return spread.select_spread(P.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 100)


# --- paired study ------------------------------------------------------------

_STUDY_SQL = """o AS (SELECT o_orderkey AS query_id, o_custkey AS c, o_totalprice AS price, CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END AS made,
      o_orderstatus = 'P' AND o_custkey % 10 = 0 AS failed FROM orders),
    l AS (SELECT l_orderkey AS query_id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS att, l_quantity, l_discount, l_tax FROM lineitem),
    p AS (SELECT query_id, count_if(att <= made) > 0 AS held, count_if(att <= made AND l_quantity = 50) > 0 AS moved, count_if(att <= made AND (l_discount = 0.1 OR l_tax = 0.08)) > 0 AS bare
      FROM o JOIN l USING (query_id) GROUP BY 1),
    t AS (SELECT o.*, coalesce(held, false) AS held, coalesce(moved, false) AS moved, coalesce(bare, false) AS bare, (made = 2) <> (c % 47 = 0) AS rewritten,
        CASE WHEN made = 1 THEN c % 5 <> 0 ELSE c % 2 = 0 END <> (c % 41 = 0) AS generates, c % 67 <> 0 AS timed FROM o LEFT JOIN p USING (query_id)),
    v AS (SELECT query_id, unnest(list_filter([
        CASE WHEN c % 43 = 0 THEN 'states_broken' END, CASE WHEN c % 71 = 0 THEN 'attempts_not_consecutive' END, CASE WHEN c % 73 = 0 THEN 'states_and_attempts_differ' END,
        CASE WHEN made = 1 AND rewritten THEN 'single_pass_rewrites' END, CASE WHEN made = 2 AND c % 79 = 0 THEN 'recovery_after_success' END,
        CASE WHEN made = 2 AND NOT rewritten THEN 'recovery_without_rewrite' END, CASE WHEN made = 2 AND rewritten AND c % 53 = 0 THEN 'recovery_asks_otherwise' END,
        CASE WHEN c % 41 = 0 THEN 'end_contradicts_assessment' END, CASE WHEN c % 59 = 0 THEN 'end_contradicts_answer' END,
        CASE WHEN timed AND (c % 61 = 0 OR c % 83 = 0) THEN 'timings_differ' END, CASE WHEN c % 31 = 0 THEN 'provenance_count' END, CASE WHEN c % 37 = 0 THEN 'provenance_used' END,
        CASE WHEN moved OR (held AND c % 71 = 0) THEN 'provenance_attempt' END, CASE WHEN bare THEN 'provenance_source' END,
        CASE WHEN timed AND made = 2 AND c % 61 = 0 THEN 'bound_passes' END, CASE WHEN timed AND rewritten AND c % 83 = 0 THEN 'bound_rewrites' END], lambda x: x IS NOT NULL)) AS check_name
      FROM t WHERE NOT failed AND c % 89 <> 0),
    g AS (SELECT t.*, c % 89 <> 0 AS traced, query_id IN (SELECT query_id FROM v WHERE NOT starts_with(check_name, 'provenance_') AND NOT starts_with(check_name, 'bound_')) AS bad_trace,
        query_id IN (SELECT query_id FROM v WHERE starts_with(check_name, 'provenance_')) AS bad_provenance, query_id IN (SELECT query_id FROM v WHERE starts_with(check_name, 'bound_')) AS bad_bound FROM t)"""


def adaptive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as adaptive answers, their lines as the evidence of up to two attempts."""
    c, made = F.col("o_custkey"), F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(1)
    attempt = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2)
    source = F.struct(
        (attempt + (F.col("l_quantity") == 50).cast("int")).alias("attempt_number"), F.concat(F.lit("c"), "l_partkey").alias("chunk_id"),
        F.when(F.col("l_discount") == 0.1, "").otherwise("u").alias("citation_url"), F.lit("s").alias("source_url"), F.when(F.col("l_tax") != 0.08, "d").alias("document_sha256"),
    )
    lines = _lists(P.table(spark, sf_dir, "lineitem"), p1=F.when(attempt == 1, source), p2=F.when(attempt == 2, source))
    none = F.array().cast("array<struct<attempt_number:int,chunk_id:string,citation_url:string,source_url:string,document_sha256:string>>")
    rows = P.table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumns({"p1": F.coalesce("p1", none), "p2": F.coalesce("p2", none), "made": made})
    more = F.lit("q more")
    rows = rows.withColumns({
        "rewritten_query": F.when((F.col("made") == 2) != (c % 47 == 0), more),
        "generates": F.when(F.col("made") == 1, c % 5 != 0).otherwise(c % 2 == 0) != (c % 41 == 0),
    })

    def made_attempt(number: int, asked: Column, sufficient: Column) -> Column:
        returned = F.size(f"p{number}") + (c % 31 == 0).cast("int")
        return F.struct(
            (F.lit(number) - (c % 71 == 0).cast("int")).alias("attempt_number"), asked.alias("retrieval_query"), returned.alias("returned_evidence_count"),
            (returned + (c % 37 == 0).cast("int")).alias("used_evidence_count"), sufficient.alias("sufficient"), F.col(f"p{number}").alias("provenance"),
        )

    first = made_attempt(1, F.lit("q"), F.when(F.col("made") == 1, c % 5 != 0).otherwise(c % 79 == 0))
    second = made_attempt(2, F.when(c % 53 == 0, F.lit("q")).otherwise(more), c % 2 == 0)
    end = F.when(F.col("generates"), "generate").otherwise("grounded_refusal")
    names = [F.lit(s) for s in ("retrieve_initial", "assess_initial", "rewrite_query", "retrieve_recovery", "assess_recovery")]
    states = F.when((F.col("made") == 2) != (c % 73 == 0), F.array(*names, end)).otherwise(F.array(*names[:2], end))
    timed, traced = c % 67 != 0, c % 89 != 0
    return rows.select(
        F.col("o_orderkey").alias("query_id"), c.alias("number"), "made", ((F.col("o_orderstatus") == "P") & (c % 10 == 0)).alias("generation_failed"),
        (F.col("o_totalprice") / 100).alias("total_latency_ms"), F.when(timed, F.col("o_totalprice") / 400).alias("retrieval_ms"),
        F.when(timed, F.col("o_totalprice") / 1000).alias("evidence_build_ms"), F.lit("q").alias("original_query"), "rewritten_query",
        F.when(traced, F.when(c % 43 == 0, F.slice(states, 2, 5)).otherwise(states)).alias("states"),
        F.when(traced, F.when(F.col("made") == 2, F.array(first, second)).otherwise(F.array(first))).alias("attempts"), end.alias("terminal_state"),
        ((~F.col("generates")) != (c % 59 == 0)).alias("insufficient_evidence"), F.when(timed, F.col("made") + (c % 61 == 0).cast("int")).alias("retrieval_attempt_count"),
        F.when(timed, F.col("rewritten_query").isNotNull().cast("int") + (c % 83 == 0).cast("int")).alias("query_rewrite_count"),
    )


def single_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return P.table(spark, sf_dir, "orders").where(c % 97 != 0).select(
        F.col("o_orderkey").alias("query_id"), ((F.col("o_orderstatus") == "P") & (c % 7 == 0)).alias("generation_failed"),
        (F.col("o_totalprice") / 125).alias("total_latency_ms"), (F.col("o_totalprice") / 800).alias("retrieval_ms"),
        (F.col("o_totalprice") / 1000).alias("evidence_build_ms"), F.lit(1).alias("retrieval_attempt_count"), F.lit(0).alias("query_rewrite_count"),
    )


@query("adaptive_trace_violations", f"WITH {_STUDY_SQL} SELECT query_id, check_name FROM v")
def adaptive_trace_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_study.trace_violations(adaptive_runs(spark, sf_dir)).select("query_id", "check_name")


def study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    treated = paired_study.diagnostics(adaptive_runs(spark, sf_dir)).withColumn("condition", F.lit("bounded_adaptive"))
    base = paired_study.single_pass_diagnostics(single_runs(spark, sf_dir)).withColumn("condition", F.lit("single_pass"))
    return stored(treated.unionByName(base))


_REPORT_SQL = """rows AS (
      SELECT 'bounded_adaptive' AS condition, failed, price / 100 AS total_latency_ms, CASE WHEN timed THEN price / 400 END AS retrieval_ms, CASE WHEN timed THEN price / 1000 END AS evidence_build_ms,
        CASE WHEN timed THEN made + (c % 61 = 0)::INT END AS n, CASE WHEN timed THEN rewritten::INT + (c % 83 = 0)::INT END AS w, NOT failed AND traced AND made = 2 AS triggered, generates,
        NOT failed AND NOT traced AS missing, NOT failed AND (NOT traced OR bad_trace) AS invalid, NOT failed AND (NOT traced OR bad_provenance) AS unsourced, NOT failed AND (NOT traced OR bad_bound) AS beyond FROM g
      UNION ALL SELECT 'single_pass', o_orderstatus = 'P' AND o_custkey % 7 = 0, o_totalprice / 125, o_totalprice / 800, o_totalprice / 1000, 1, 0, false, false, false, false, false, false FROM orders WHERE o_custkey % 97 <> 0)"""
_COUNT_SQL = """SELECT condition, count(*) AS query_count, coalesce(sum(n) FILTER (WHERE NOT failed), 0)::BIGINT AS total_retrieval_attempts, coalesce(sum(w) FILTER (WHERE NOT failed), 0)::BIGINT AS total_query_rewrites,
      count_if(triggered)::BIGINT AS recovery_trigger_count, count_if(triggered AND generates)::BIGINT AS successful_recovery_count, count_if(triggered AND NOT generates)::BIGINT AS recovery_grounded_refusal_count,
      count_if(missing)::BIGINT AS missing_trace_count, count_if(invalid)::BIGINT AS invalid_trace_count, count_if(unsourced)::BIGINT AS invalid_provenance_count, count_if(beyond)::BIGINT AS bound_violation_count,
      round(avg(total_latency_ms) FILTER (WHERE NOT failed), 6) AS mean_total_latency_ms, round(avg(retrieval_ms) FILTER (WHERE NOT failed), 6) AS mean_retrieval_ms,
      round(avg(evidence_build_ms) FILTER (WHERE NOT failed), 6) AS mean_evidence_build_ms, round(avg(n) FILTER (WHERE NOT failed), 6) AS mean_retrieval_attempt_count,
      round(quantile_cont(total_latency_ms, 0.5) FILTER (WHERE NOT failed), 6) AS p50_total_latency_ms, round(quantile_cont(total_latency_ms, 0.95) FILTER (WHERE NOT failed), 6) AS p95_total_latency_ms,
      round(quantile_cont(retrieval_ms, 0.5) FILTER (WHERE NOT failed), 6) AS p50_retrieval_ms, round(quantile_cont(retrieval_ms, 0.95) FILTER (WHERE NOT failed), 6) AS p95_retrieval_ms FROM rows GROUP BY 1"""


@query("adaptive_condition_report", f"WITH {_STUDY_SQL}, {_REPORT_SQL} {_COUNT_SQL}")
def adaptive_condition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = paired_study.condition_report(study_rows(spark, sf_dir))
    return report.withColumns({c: F.round(c, 6) for c in report.columns if c.startswith(("mean_", "p50_", "p95_"))})


_QUALITY_SQL = """ev AS (
      SELECT condition, failed, wanted, given, claims, cited, refs, valid, cites, backed, terms, least(terms, matched) AS matched,
        NOT failed AND CASE WHEN given THEN claims > 0 AND cited = claims AND valid = refs AND backed = cites ELSE claims + cites = 0 END AS sound
      FROM (SELECT condition, failed, o_orderstatus <> 'O' AS wanted, CASE WHEN NOT failed THEN given END AS given, count(l_orderkey) FILTER (WHERE NOT failed AND part) AS claims,
          count(l_orderkey) FILTER (WHERE NOT failed AND part AND l_discount <> 0.1) AS cited, count(l_orderkey) FILTER (WHERE NOT failed AND part AND l_discount <> 0.1) AS refs,
          count(l_orderkey) FILTER (WHERE NOT failed AND part AND l_discount <> 0.1 AND l_tax <> 0.08) AS valid, count(l_orderkey) FILTER (WHERE NOT failed AND part) AS cites,
          count(l_orderkey) FILTER (WHERE NOT failed AND part AND l_quantity <> 50) AS backed, 1 + o_custkey % 3 AS terms, count(l_orderkey) FILTER (WHERE NOT failed AND part) AS matched
        FROM (SELECT k.condition, o.*, l.*, CASE WHEN k.condition = 'single_pass' THEN o_orderstatus = 'P' AND o_custkey % 7 = 0 ELSE o_orderstatus = 'P' AND o_custkey % 10 = 0 END AS failed,
            CASE WHEN k.condition = 'single_pass' THEN o_custkey % 5 <> 0 ELSE o_custkey % 6 <> 0 END AS given, k.condition <> 'single_pass' OR l_returnflag = 'A' AS part
          FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey, (VALUES ('single_pass'), ('bounded_adaptive')) k(condition)) GROUP BY condition, failed, given, o_orderkey, o_orderstatus, o_custkey)),
    rates AS (SELECT condition, count_if(failed) / count(*) AS generation_failure_rate, count_if(given = wanted) / count(*) AS answerability_accuracy,
        count_if(wanted AND given) / count_if(wanted) AS answerable_completion_rate, count_if(NOT wanted AND NOT given) / count_if(NOT wanted) AS unsupported_refusal_rate, sum(cited) / sum(claims) AS claim_citation_coverage_rate,
        sum(valid) / sum(refs) AS citation_reference_validity_rate, sum(backed) / sum(cites) AS source_document_coverage_rate, sum(matched) / sum(terms) AS expected_term_recall, count_if(sound) / count(*) AS structural_validity_rate FROM ev GROUP BY 1)"""


def study_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated answers of both conditions: the lines of an order are its claims, each with one citation."""
    lines = P.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    conditions = F.explode(F.array(F.lit("single_pass"), F.lit("bounded_adaptive"))).alias("condition")
    c, single = F.col("o_custkey"), F.col("condition") == "single_pass"
    orders = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", conditions).withColumns({
        "generation_failed": (F.col("o_orderstatus") == "P") & (c % F.when(single, 7).otherwise(10) == 0), "given": c % F.when(single, 5).otherwise(6) != 0,
    })
    part = F.col("l_returnflag").isNotNull() & (~single | (F.col("l_returnflag") == "A")) & ~F.col("generation_failed")
    cited, real = part & (F.col("l_discount") != 0.1), part & (F.col("l_quantity") != 50)
    keys = ["condition", "o_orderkey", "o_custkey", "o_orderstatus", "generation_failed", "given"]
    counted = orders.join(lines, "o_orderkey", "left").groupBy(*keys).agg(
        F.count_if(part).alias("claim_count"), F.count_if(cited).alias("cited_claim_count"), F.count_if(cited).alias("total_citation_reference_count"),
        F.count_if(cited & (F.col("l_tax") != 0.08)).alias("valid_citation_reference_count"), F.count_if(part).alias("citation_count"),
        F.count_if(real).alias("source_backed_citation_count"),
    )
    given, wanted, terms = F.when(~F.col("generation_failed"), F.col("given")), F.col("o_orderstatus") != "O", 1 + c % 3
    sound = (
        (F.col("claim_count") > 0) & (F.col("cited_claim_count") == F.col("claim_count"))
        & (F.col("valid_citation_reference_count") == F.col("total_citation_reference_count")) & (F.col("source_backed_citation_count") == F.col("citation_count"))
    )
    return counted.select(
        "condition", F.col("o_orderkey").alias("query_id"), wanted.alias("expected_answerable"), given.alias("predicted_answerable"), "generation_failed",
        "claim_count", "citation_count", "cited_claim_count", "total_citation_reference_count", "valid_citation_reference_count", "source_backed_citation_count",
        terms.alias("expected_term_count"), F.least(terms, F.col("claim_count")).alias("matched_term_count"),
        F.coalesce(given == wanted, F.lit(False)).alias("answerability_correct"),
        F.when(F.col("generation_failed"), F.lit(False)).when(given, sound).otherwise(F.col("claim_count") + F.col("citation_count") == 0).alias("structurally_valid"),
    )


_DELTAS = [*answer_metrics.RATES, *paired_study.LATENCIES]


@query(
    "adaptive_paired_deltas",
    f"""WITH {_STUDY_SQL}, {_REPORT_SQL}, {_QUALITY_SQL}, r AS ({_COUNT_SQL.replace('round(', '(').replace(', 6) AS', ') AS')}), b AS (SELECT * FROM rates JOIN r USING (condition))
      SELECT unnest([{', '.join(f"'{m}'" for m in _DELTAS)}]) AS metric, unnest([{', '.join(f"round(t.{m}::DOUBLE - s.{m}::DOUBLE, 6)" for m in _DELTAS)}]) AS delta
      FROM b t, b s WHERE t.condition = 'bounded_adaptive' AND s.condition = 'single_pass'""",
)
def adaptive_paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen metrics, adaptive minus single pass, each rounded once."""
    quality = answer_metrics.summarize_answers(study_answers(spark, sf_dir), ["condition"], None).select("condition", *answer_metrics.RATES)
    both = stored(quality.join(paired_study.condition_report(study_rows(spark, sf_dir)), "condition"))
    return answer_metrics.condition_deltas(both, "condition", "bounded_adaptive", "single_pass", _DELTAS).select("metric", "delta")


@query(
    "paired_questions",
    f"""WITH {_STUDY_SQL}, b AS (SELECT o_orderkey AS query_id, o_totalprice AS p FROM orders WHERE o_custkey % 97 <> 0)
      SELECT query_id, b.p IS NOT NULL AS paired, round(price / 100 - p / 125, 6) AS total_latency_ms_delta,
        CASE WHEN p IS NOT NULL THEN (CASE WHEN timed THEN made + (c % 61 = 0)::INT END - 1)::DOUBLE END AS retrieval_attempt_count_delta FROM t LEFT JOIN b USING (query_id)""",
)
def paired_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = paired_study.paired_questions(single_runs(spark, sf_dir), adaptive_runs(spark, sf_dir), ["total_latency_ms", "retrieval_attempt_count"])
    return pairs.withColumn("total_latency_ms_delta", F.round("total_latency_ms_delta", 6))


_FLOORS = {"single_pass": 0.55, "bounded_adaptive": 0.7}
_FLOOR_SQL = " UNION ALL ".join(
    f"SELECT condition, {i + 4} AS position, '{m}: found ' || printf('%.4f', {m}) || ', required at least ' || printf('%.4f', least) AS failure FROM p WHERE {m} < least"
    for i, m in enumerate(answer_metrics.FLOORS)
)


@query(
    "policy_failures",
    f"""WITH {_QUALITY_SQL}, p AS (SELECT *, CASE condition {' '.join(f"WHEN '{c}' THEN {v}" for c, v in _FLOORS.items())} END AS least,
          (SELECT count(*) FROM orders) AS query_count, (SELECT min(o_orderpriority) FROM orders) AS generation_model FROM rates)
      SELECT condition, position, failure FROM (
        SELECT 'other' AS condition, 0 AS position, 'report: missing' AS failure
        UNION ALL SELECT condition, 1, 'query_count: expected ' || (SELECT count(*) FROM customer) || ', found ' || query_count FROM p WHERE query_count <> (SELECT count(*) FROM customer)
        UNION ALL SELECT condition, 2, 'generation_provider: expected ''remote'', found ''local''' FROM p WHERE condition = 'single_pass'
        UNION ALL SELECT condition, 3, 'generation_model: expected ''5-LOW'', found ''' || generation_model || '''' FROM p WHERE generation_model <> '5-LOW'
        UNION ALL {_FLOOR_SQL})""",
)
def policy_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conditions against a policy each, with all identities and floors; a third policy has no report."""
    orders = P.table(spark, sf_dir, "orders").agg(F.min("o_orderpriority").alias("generation_model"))
    reports = answer_metrics.summarize_answers(study_answers(spark, sf_dir), ["condition"], None).select(
        "condition", "query_count", F.lit("local").alias("generation_provider"), orders.scalar().alias("generation_model"), *answer_metrics.FLOORS
    )
    customers = P.table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    rows = [(c, "remote" if c == "single_pass" else "local", *[v] * len(answer_metrics.FLOORS)) for c, v in [*_FLOORS.items(), ("other", 0.5)]]
    names = ["condition", "expected_generation_provider", *[f"minimum_{m}" for m in answer_metrics.FLOORS]]
    policies = spark.createDataFrame(rows, names).select(
        "*", customers.scalar().alias("expected_query_count"), F.lit("5-LOW").alias("expected_generation_model")
    )
    return answer_metrics.policy_failures(reports, policies, "condition")
