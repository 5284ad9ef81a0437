"""Registered evaluation, telemetry, review and agent queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import vectors as V
from citeweave.operators import agents, answer_metrics, calibration, dense, review, service_metrics
from citeweave.operators.scale import exact_quantiles
from citeweave.plans import tables as P
from citeweave.plans.registry import query
from citeweave.streaming import rate_limit, telemetry

# --- service telemetry over events ------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "events")


@query(
    "latency_percentiles",
    """SELECT event_type, count(value) AS n, round(min(value), 6) AS minimum_ms, round(avg(value), 6) AS mean_ms,
       round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
       round(quantile_cont(value, 0.99), 6) AS p99_ms, round(max(value), 6) AS maximum_ms FROM events GROUP BY 1""",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_metrics.latency_summary(events(spark, sf_dir), ["event_type"], "value", digits=6)


@query(
    "latency_percentiles_by_user",
    """SELECT user_id, count(value) AS n, round(min(value), 6) AS minimum_ms, round(avg(value), 6) AS mean_ms,
       round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
       round(quantile_cont(value, 0.99), 6) AS p99_ms, round(max(value), 6) AS maximum_ms FROM events GROUP BY 1""",
)
def latency_percentiles_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_metrics.latency_summary(events(spark, sf_dir), ["user_id"], "value", digits=6)


# A request row per event: errors carry a status from their payload counter.
_REQUEST_SQL = """SELECT event_type, user_id, ts, value, k,
    CASE WHEN event_type <> 'error' THEN 200 WHEN k % 4 = 0 THEN 404 WHEN k % 4 = 1 THEN 503 WHEN k % 4 = 2 THEN 302 END AS status_code,
    event_type = 'view' AND k % 2 = 0 AS insufficient_evidence
    FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = events(spark, sf_dir).withColumn("k", k)
    status = (
        F.when(F.col("event_type") != "error", 200).when(F.col("k") % 4 == 0, 404).when(F.col("k") % 4 == 1, 503)
        .when(F.col("k") % 4 == 2, 302)
    )
    return rows.withColumn("status_code", status).withColumn(
        "insufficient_evidence", (F.col("event_type") == "view") & (F.col("k") % 2 == 0)
    )


_STATUS_SQL = """CASE WHEN status_code IS NULL THEN 'transport_error' WHEN status_code BETWEEN 200 AND 299 THEN '2xx'
    WHEN status_code BETWEEN 400 AND 499 THEN '4xx' WHEN status_code BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END"""


@query(
    "load_report",
    f"""WITH r AS ({_REQUEST_SQL}), c AS (SELECT *, {_STATUS_SQL} AS s FROM r),
        a AS (SELECT user_id % 4 AS run, count(*) AS request_count, count(*) FILTER (WHERE s = '2xx') AS success_count,
          count(*) FILTER (WHERE s = '4xx') AS status_4xx_count, count(*) FILTER (WHERE s = '5xx') AS status_5xx_count,
          count(*) FILTER (WHERE s = 'other') AS other_status_count, count(*) FILTER (WHERE s = 'transport_error') AS transport_error_count,
          count(*) FILTER (WHERE s = '2xx' AND insufficient_evidence) AS insufficient_evidence_count,
          (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall_seconds FROM c GROUP BY 1)
        SELECT run, request_count, success_count, status_4xx_count, status_5xx_count, other_status_count, transport_error_count,
          insufficient_evidence_count, round(wall_seconds, 6) AS wall_seconds, request_count - success_count AS failure_count,
          round(success_count / request_count, 6) AS success_rate,
          round(CASE WHEN success_count = 0 THEN 0 ELSE insufficient_evidence_count / success_count END, 6) AS refusal_rate,
          round(request_count / wall_seconds, 6) AS requests_per_second FROM a""",
)
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).withColumn("run", F.col("user_id") % 4)
    wall = "(unix_micros(max(cast(ts as timestamp))) - unix_micros(min(cast(ts as timestamp)))) / 1e6D"
    return service_metrics.load_report(rows, ["run"], wall)


_BOUNDS = service_metrics.DURATION_BUCKETS


@query(
    "histogram_buckets",
    f"""WITH r AS ({_REQUEST_SQL}), t AS (SELECT event_type, count(*) AS requests_total,
          {', '.join(f'count(*) FILTER (WHERE value / 10.0::DOUBLE <= {b}) AS b{i}' for i, b in enumerate(_BOUNDS))} FROM r GROUP BY 1)
        {' UNION ALL '.join(f"SELECT event_type, requests_total, '{b}' AS le, b{i} AS bucket_count FROM t" for i, b in enumerate(_BOUNDS))}
        UNION ALL SELECT event_type, requests_total, '+Inf', requests_total FROM t""",
)
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).withColumn("seconds", F.col("value") / 10.0)
    return service_metrics.request_counters(rows, ["event_type"], "seconds")


_NEAREST = "list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::BIGINT + 1]"


@query(
    "reliability_by_scenario",
    f"""WITH r AS ({_REQUEST_SQL}) SELECT event_type AS scenario, count(*) AS request_count,
          round(avg((coalesce(status_code, 0) = 200)::INT), 6) AS success_rate,
          round(avg((status_code IS NULL)::INT), 6) AS timeout_rate,
          round(avg(insufficient_evidence::INT), 6) AS safe_refusal_rate, round(avg((k % 97 = 0)::INT), 6) AS unsafe_answer_rate,
          round(CASE WHEN count(*) FILTER (WHERE coalesce(status_code, 0) <> 200) = 0 THEN 1.0::DOUBLE
            ELSE count(*) FILTER (WHERE coalesce(status_code, 0) <> 200 AND k % 3 = 0) / count(*) FILTER (WHERE coalesce(status_code, 0) <> 200) END, 6) AS recovery_rate,
          round(quantile_cont(value, 0.5), 6) AS p50_latency_ms, {_NEAREST} AS p95_latency_ms FROM r GROUP BY 1""",
)
def reliability_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce(F.col("status_code") == 200, F.lit(False))
    rows = requests(spark, sf_dir).select(
        F.col("event_type").alias("scenario"), F.col("value").alias("latency_ms"), ok.alias("success"),
        F.col("status_code").isNull().alias("timed_out"), (~ok).alias("recovery_attempted"),
        (F.col("k") % 3 == 0).alias("recovered"), F.col("insufficient_evidence").alias("safe_refusal"),
        (F.col("k") % 97 == 0).alias("unsafe_answer"),
    )
    return service_metrics.reliability(rows, ["scenario"])


@query(
    "provider_telemetry",
    f"""WITH r AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'fake' WHEN 1 THEN 'huggingface' ELSE 'remote-api' END AS provider,
          CASE WHEN event_type = 'error' THEN NULL ELSE event_type <> 'view' END AS called, event_type <> 'view' AS expected,
          value / 100 AS lat, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
        t AS (SELECT *, provider <> 'fake' AS te, CASE WHEN called THEN 1 + k % 3 END AS attempts, CASE WHEN called THEN lat END AS l,
          CASE WHEN called THEN 100 + k END AS i, CASE WHEN called THEN 10 + k END AS o FROM r)
        SELECT provider, CASE provider WHEN 'fake' THEN 'deterministic' WHEN 'huggingface' THEN 'local_model' ELSE 'remote' END AS provider_kind,
          any_value(te) AS telemetry_expected, count(*) AS query_count, count(*) FILTER (WHERE called) AS provider_call_count,
          count(*) FILTER (WHERE te AND NOT called) AS provider_bypass_count, count(*) FILTER (WHERE te AND called IS NULL) AS provider_call_unknown_count,
          count(*) FILTER (WHERE te AND called IS NOT NULL) AS policy_evaluated_count,
          count(*) FILTER (WHERE te AND called = expected) AS policy_correct_count, sum(coalesce(attempts, 0))::BIGINT AS total_attempts,
          count(*) FILTER (WHERE attempts > 1) AS retried_call_count, sum(coalesce(i, 0))::BIGINT AS total_input_tokens,
          sum(coalesce(o, 0))::BIGINT AS total_output_tokens,
          round(sum(coalesce(i / 1e6 * 2.5::DOUBLE + o / 1e6 * 10.0::DOUBLE, 0)), 6) AS total_estimated_cost_usd,
          round(avg(l), 6) AS mean_latency_seconds, round(avg(i), 6) AS mean_input_tokens,
          CASE WHEN any_value(te) THEN round(count(*) FILTER (WHERE te AND NOT called) / count(called), 6) END AS provider_bypass_rate,
          CASE WHEN any_value(te) THEN round(count(*) FILTER (WHERE te AND called = expected) / count(*) FILTER (WHERE te AND called IS NOT NULL), 6) END AS policy_accuracy,
          CASE WHEN any_value(te) THEN round(count(*) FILTER (WHERE attempts > 1) / count(*) FILTER (WHERE called), 6) END AS retry_rate,
          round(quantile_cont(l, 0.5), 6) AS p50_latency_seconds, round(quantile_cont(l, 0.95), 6) AS p95_latency_seconds
        FROM t GROUP BY provider""",
)
def provider_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    called = F.when(F.col("event_type") != "error", F.col("event_type") != "view")
    rows = events(spark, sf_dir).select(
        F.when(F.col("user_id") % 3 == 0, "fake").when(F.col("user_id") % 3 == 1, "huggingface")
        .otherwise("remote-api").alias("provider"),
        called.alias("provider_called"), (F.col("event_type") != "view").alias("expected_answerable"),
        F.when(called, 1 + k % 3).alias("attempts"), F.when(called, F.col("value") / 100).alias("latency_seconds"),
        F.when(called, 100 + k).alias("input_tokens"), F.when(called, 10 + k).alias("output_tokens"),
    )
    priced = rows.withColumn(
        "estimated_cost_usd", answer_metrics.estimate_cost(F.col("input_tokens"), F.col("output_tokens"), 2.5, 10.0)
    )
    return answer_metrics.provider_telemetry(priced)


@query(
    "rate_limiter",
    """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
       s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS log, NULL::BOOLEAN AS allowed, 0 AS remaining, 0::BIGINT AS retry
             FROM (SELECT DISTINCT user_id FROM events)
         UNION ALL
         SELECT user_id, n, event_id, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END, len(kept) < 2,
           CASE WHEN len(kept) < 2 THEN 1 - len(kept) ELSE 0 END,
           CASE WHEN len(kept) < 2 THEN 0 ELSE greatest(1, floor((86400000000 - (t - kept[1])) / 1e6)::BIGINT + 1) END
         FROM (SELECT r.user_id, r.n, r.event_id, r.t, list_filter(s.log, lambda x: x > r.t - 86400000000) AS kept
               FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))
       SELECT event_id AS request_id, user_id::VARCHAR AS key, allowed, remaining::INT AS remaining, retry::INT AS retry_after_seconds
       FROM s WHERE event_id IS NOT NULL""",
)
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("key"), "ts"
    )
    return rate_limit.limit_requests(rows, limit=2, window_seconds=86_400)


@query(
    "windowed_telemetry",
    f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS requests_total,
        round(sum(value), 6) AS duration_sum, {', '.join(f'count(*) FILTER (WHERE value <= {b}) AS le_{i}' for i, b in enumerate(_BOUNDS))}
        FROM events GROUP BY 1, 2""",
)
def windowed_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.windowed_counters(events(spark, sf_dir), "ts", ["event_type"], "value")
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "duration_sum", F.round("duration_sum", 6)
    )


@query(
    "log_lines",
    """SELECT event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', (epoch_us(ts) // 1000) % 1000) || 'Z","level":"' || event_type || '","user_id":' || user_id || '}' AS value FROM events""",
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events(spark, sf_dir).select(
        "event_id", F.to_json(F.struct(stamp.alias("timestamp"), F.col("event_type").alias("level"), "user_id")).alias("value")
    )


@query(
    "token_weighted_loss",
    """SELECT event_type, round(sum(value * k) / sum(k), 6) AS mean_loss FROM
       (SELECT event_type, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events) GROUP BY 1""",
)
def token_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events(spark, sf_dir).groupBy("event_type").agg(
        F.round(F.sum(F.col("value") * k) / F.sum(k), 6).alias("mean_loss")
    )


@query(
    "runtime_throughput",
    """SELECT event_type, count(*) AS iterations, sum(k)::BIGINT AS output_tokens, round(avg(value), 6) AS mean_ms,
       round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
       round(sum(k) / (sum(value) / 1000), 6) AS tokens_per_second
       FROM (SELECT event_type, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""",
)
def runtime_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
        F.col("value").alias("latency_ms"),
    )
    return service_metrics.throughput(rows, "event_type", digits=6)


# --- policy variants and rewards over requests ------------------------------

_OBS_SQL = """SELECT e.event_id % 3333 AS case_no, ['base', 'lora_sft', 'grpo'][1 + (user_id % 3)] AS variant, event_type, value, k,
    event_type <> 'error' AS ok, k % 2 = 0 AS even_k, k % 5 AS calls FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) e"""


@query(
    "policy_ablation",
    f"""WITH o AS ({_OBS_SQL}) SELECT variant, count(*) AS case_count, round(avg(ok::INT), 6) AS task_success_rate,
          round(avg((ok OR even_k)::INT), 6) AS refusal_accuracy, round(avg(even_k::INT), 6) AS citation_validity_rate,
          round(avg((k % 3 = 0)::INT), 6) AS evidence_support_rate, round(avg((k % 7 <> 0)::INT), 6) AS tool_selection_accuracy,
          round(avg((k % 11 <> 0)::INT), 6) AS structured_output_rate, round(avg(calls), 6) AS mean_tool_calls,
          round(quantile_cont(value, 0.5), 6) AS p50_latency_ms, {_NEAREST} AS p95_latency_ms FROM o GROUP BY 1""",
)
def policy_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    ok = F.col("event_type") != "error"
    names = F.array(F.lit("base"), F.lit("lora_sft"), F.lit("grpo"))
    rows = events(spark, sf_dir).select(
        F.element_at(names, (1 + F.col("user_id") % 3).cast("int")).alias("variant"),
        ok.alias("task_success"), (ok | (k % 2 == 0)).alias("refusal_correct"), (k % 2 == 0).alias("citation_valid"),
        (k % 3 == 0).alias("evidence_supported"), (k % 7 != 0).alias("tool_selection_correct"),
        (k % 11 != 0).alias("structured_output_valid"), (k % 5).alias("tool_calls"), F.col("value").alias("latency_ms"),
    )
    return service_metrics.variant_metrics(rows)


_REWARD_SQL = """WITH b AS (SELECT event_id, event_type <> 'view' AS answerable, event_type IN ('click', 'purchase') OR k % 4 = 0 AS answered,
      event_type = 'view' AND k % 4 <> 0 AS refused, k % 3 <> 0 AS correct, k % 5 <> 0 AS cited, k % 7 <> 0 AS supported,
      k % 11 <> 0 AS structured, k % 2 = 0 AS tool, k % 9 AS calls, k % 4 AS needed
      FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)),
    raw AS (SELECT *, ((answerable AND answered AND correct AND supported)::INT + (NOT answerable AND refused)::INT + (answered AND cited)::INT
      + (answered AND supported)::INT + structured::INT * 0.25 + tool::INT * 0.5 - 0.1 * greatest(calls - needed, 0))::DOUBLE AS x FROM b),
    capped AS (SELECT *, CASE WHEN NOT answerable AND answered AND NOT refused THEN least(x, 0) ELSE x END AS y FROM raw),
    scored AS (SELECT event_id, round(CASE WHEN answered AND NOT cited THEN least(y, 0.25) ELSE y END, 6) AS total FROM capped)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        "event_id", (kind != "view").alias("answerable"),
        (kind.isin("click", "purchase") | (k % 4 == 0)).alias("answered"),
        ((kind == "view") & (k % 4 != 0)).alias("refused"), (k % 3 != 0).alias("answer_correct"),
        (k % 5 != 0).alias("citation_valid"), (k % 7 != 0).alias("evidence_supported"),
        (k % 11 != 0).alias("structured_output_valid"), (k % 2 == 0).alias("required_tool_selected"),
        (k % 9).alias("tool_call_count"), (k % 4).alias("necessary_tool_calls"),
    )


@query("reward_scores", f"{_REWARD_SQL} SELECT event_id, total FROM scored")
def reward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_metrics.reward(rollouts(spark, sf_dir)).select("event_id", "total")


@query(
    "reward_summary",
    f"{_REWARD_SQL} SELECT count(*) AS count, round(avg(total), 6) AS mean, min(total) AS minimum, max(total) AS maximum FROM scored",
)
def reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_metrics.reward_summary(service_metrics.reward(rollouts(spark, sf_dir)))


# --- annotators, review units, adjudication ---------------------------------

_RESPONSES_SQL = """SELECT doc_id AS task_id, 'first' AS annotator_id, CASE quality WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS decision FROM labels
    UNION ALL SELECT doc_id, 'second', CASE WHEN toxic = 1 THEN 'rejected' WHEN doc_id % 10 = 0 THEN 'uncertain' ELSE 'confirmed' END FROM labels WHERE doc_id % 7 <> 0"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = P.table(spark, sf_dir, "labels")
    first = labels.select(
        F.col("doc_id").alias("task_id"), F.lit("first").alias("annotator_id"),
        F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("decision"),
    )
    second = labels.where("doc_id % 7 <> 0").select(
        F.col("doc_id").alias("task_id"), F.lit("second").alias("annotator_id"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("doc_id") % 10 == 0, "uncertain").otherwise("confirmed").alias("decision"),
    )
    return first.unionByName(second)


@query(
    "annotator_agreement",
    f"""WITH r AS ({_RESPONSES_SQL}), j AS (SELECT a.decision AS a, b.decision AS b FROM r a JOIN r b USING (task_id)
          WHERE a.annotator_id = 'first' AND b.annotator_id = 'second')
        SELECT count(*) AS comparable_task_count, count(*) FILTER (WHERE a = b) AS exact_match_count, round(avg((a = b)::INT), 6) AS exact_match_rate,
          count(*) FILTER (WHERE a <> b) AS disagreement_count, count(*) FILTER (WHERE a <> b) > 0 AS adjudication_required FROM j""",
)
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.annotator_agreement(responses(spark, sf_dir), "first", "second")


@query(
    "decision_counts",
    f"""WITH r AS ({_RESPONSES_SQL}) SELECT annotator_id, count(*) FILTER (WHERE decision = 'confirmed') AS confirmed,
        count(*) FILTER (WHERE decision = 'rejected') AS rejected, count(*) FILTER (WHERE decision = 'uncertain') AS uncertain FROM r GROUP BY 1""",
)
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_counts(responses(spark, sf_dir), ["confirmed", "rejected", "uncertain"])


@query(
    "review_gaps",
    f"""WITH r AS ({_RESPONSES_SQL}), x AS (SELECT doc_id AS task_id, a AS annotator_id FROM documents, (VALUES ('first'), ('second')) v(a))
        SELECT *, 'missing' AS problem FROM (SELECT task_id, annotator_id FROM x EXCEPT SELECT task_id, annotator_id FROM r)
        UNION ALL SELECT *, 'unexpected' FROM (SELECT task_id, annotator_id FROM r EXCEPT SELECT task_id, annotator_id FROM x)""",
)
def review_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"))
    return review.review_gaps(tasks, responses(spark, sf_dir), ["first", "second"])


# The review queue: every line of every document, per source system; lines that
# start with a licence notice carry an automatic label.
_QUEUE_SQL = """SELECT doc_id || ':' || i AS review_id, source AS system, doc_id::VARCHAR AS query_id, line,
      CASE WHEN starts_with(line, 'Licensed') THEN 'PRESENT' END AS automatic_label FROM (
        SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""
_TASK_SQL = """sha256('{"line": ' || coalesce(to_json(line)::VARCHAR, 'null') || '}')"""
_UNITS_SQL = f"""SELECT 'unit_' || printf('%03d', row_number() OVER (ORDER BY fingerprint)) AS unit_id, fingerprint, member_count, first_review_id,
      (row_number() OVER (ORDER BY fingerprint) - 1) // 25 + 1 AS batch_no FROM (
        SELECT {_TASK_SQL} AS fingerprint, count(*) AS member_count, min(review_id) AS first_review_id FROM queue WHERE automatic_label IS NULL GROUP BY 1)"""
_DECISION_SQL = """SELECT unit_id, CASE (('0x' || substr(fingerprint, 1, 2))::UBIGINT) % 3 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'ABSENT' ELSE 'AMBIGUOUS' END AS human_label FROM units"""
_REVIEW = f"WITH queue AS MATERIALIZED ({_QUEUE_SQL}), units AS MATERIALIZED ({_UNITS_SQL}), decisions AS ({_DECISION_SQL}), final AS (SELECT q.*, u.unit_id, coalesce(automatic_label, human_label) AS final_label FROM queue q LEFT JOIN units u ON u.fingerprint = {_TASK_SQL} AND automatic_label IS NULL LEFT JOIN decisions USING (unit_id))"


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.documents(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(
        F.concat_ws(":", "doc_id", F.col("pos") + 1).alias("review_id"), F.col("source").alias("system"),
        F.col("doc_id").cast("string").alias("query_id"), "line",
        F.when(F.col("line").startswith("Licensed"), "PRESENT").alias("automatic_label"),
    )


def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = review_queue(spark, sf_dir)
    pending = queue.where("automatic_label IS NULL")
    units = review.review_units(pending, ["line"])
    label = F.pmod(F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int"), F.lit(3))
    decisions = units.select(
        "unit_id", F.when(label == 0, "PRESENT").when(label == 1, "ABSENT").otherwise("AMBIGUOUS").alias("human_label")
    )
    members = review.unit_members(pending, units, ["line"])
    return review.adjudicate(queue, members, decisions)


@query("review_units", f"{_REVIEW} SELECT unit_id, fingerprint, member_count, first_review_id, batch_no FROM units")
def review_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_units(review_queue(spark, sf_dir).where("automatic_label IS NULL"), ["line"])


@query("adjudicated_labels", f"{_REVIEW} SELECT review_id, unit_id, final_label FROM final")
def adjudicated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudicated(spark, sf_dir).select("review_id", "unit_id", "final_label")


@query(
    "label_rates",
    f"""{_REVIEW} SELECT system, count(*) AS total, count(*) FILTER (WHERE final_label = 'PRESENT') AS present,
        count(*) FILTER (WHERE final_label = 'ABSENT') AS absent, count(*) FILTER (WHERE final_label = 'AMBIGUOUS') AS ambiguous,
        round(count(*) FILTER (WHERE final_label = 'PRESENT') / count(*), 6) AS strict_rate,
        round(count(*) FILTER (WHERE final_label <> 'ABSENT') / count(*), 6) AS broad_rate FROM final GROUP BY GROUPING SETS ((system), ())""",
)
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.label_rates(
        adjudicated(spark, sf_dir), "system", ["PRESENT", "ABSENT", "AMBIGUOUS"],
        {"strict_rate": ["PRESENT"], "broad_rate": ["PRESENT", "AMBIGUOUS"]},
    )


@query(
    "coverage_bounds",
    f"""{_REVIEW}, pq AS (SELECT system, query_id, count(*) AS n, count(*) FILTER (WHERE final_label = 'PRESENT') AS p,
          count(*) FILTER (WHERE final_label = 'AMBIGUOUS') AS a FROM final GROUP BY 1, 2)
        SELECT system, sum(n)::BIGINT AS concept_count, sum(p)::BIGINT AS present_count, sum(a)::BIGINT AS ambiguous_count,
          round(avg(p / n), 6) AS macro_lower, round(avg((p + a) / n), 6) AS macro_upper,
          round(sum(p) / sum(n), 6) AS micro_lower, round((sum(p) + sum(a)) / sum(n), 6) AS micro_upper FROM pq GROUP BY 1""",
)
def coverage_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coverage_bounds(adjudicated(spark, sf_dir), "system")


# --- threshold calibration ---------------------------------------------------

_PAIR_SQL = """WITH s AS (SELECT a.vec_id AS l, b.vec_id AS r, a.label = b.label AS truth,
      round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS rank FROM s),
    pairs AS MATERIALIZED (SELECT l, r, truth, score FROM ranked WHERE rank <= 10)"""
_SWEEP_SQL = f"""{_PAIR_SQL}, g AS (SELECT score, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM pairs GROUP BY 1),
    w AS (SELECT score, lag(score) OVER (ORDER BY score) AS below, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g),
    t AS (SELECT CASE WHEN below IS NULL THEN score - 1e-6 ELSE (score + below) / 2 END AS threshold, tp, fp FROM w
          UNION ALL SELECT max(score) + 1e-6, 0, 0 FROM g),
    c AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (SELECT sum(neg) FROM g)::BIGINT - fp::BIGINT AS tn, (SELECT sum(pos) FROM g)::BIGINT - tp::BIGINT AS fn FROM t),
    m AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS precision FROM c),
    swept AS (SELECT *, (recall + specificity) / 2 AS balanced_accuracy FROM m)"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every vector; a pair matches when labels agree."""
    rows = P.table(spark, sf_dir, "embeddings")
    near = dense.search(
        rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")),
        rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10, exclude_self=True,
    )
    labels = rows.select("vec_id", "label")
    return (
        near.join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "a"}), "query_id")
        .join(labels.withColumnsRenamed({"vec_id": "chunk_id", "label": "b"}), "chunk_id")
        .select("score", (F.col("a") == F.col("b")).alias("truth"))
    )


@query(
    "threshold_sweep",
    f"{_SWEEP_SQL} SELECT round(threshold, 9) AS threshold, tp, fp, tn, fn, round(balanced_accuracy, 6) AS balanced_accuracy FROM swept",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.sweep(scored_pairs(spark, sf_dir)).select(
        F.round("threshold", 9).alias("threshold"), "tp", "fp", "tn", "fn",
        F.round("balanced_accuracy", 6).alias("balanced_accuracy"),
    )


_BEST = "round(threshold, 9) AS threshold, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(balanced_accuracy, 6) AS balanced_accuracy"


@query(
    "threshold_best",
    f"""{_SWEEP_SQL} SELECT * FROM (SELECT 'precision' AS rule, {_BEST} FROM swept ORDER BY swept.balanced_accuracy DESC, swept.precision DESC, swept.specificity DESC, swept.threshold DESC LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'balance', {_BEST} FROM swept ORDER BY swept.balanced_accuracy DESC, least(swept.recall, swept.specificity) DESC, swept.precision DESC, swept.threshold LIMIT 1)""",
)
def threshold_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = calibration.sweep(scored_pairs(spark, sf_dir))
    best = calibration.best_by_precision(swept).withColumn("rule", F.lit("precision")).unionByName(
        calibration.best_by_balance(swept).withColumn("rule", F.lit("balance"))
    )
    return best.select(
        "rule", F.round("threshold", 9).alias("threshold"), "tp", "fp", "tn", "fn",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "balanced_accuracy")],
    )


@query(
    "score_summary",
    f"""{_PAIR_SQL} SELECT truth, count(*) AS pair_count, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS p25,
        round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS p75, round(max(score), 6) AS max FROM pairs GROUP BY 1""",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.score_summary(scored_pairs(spark, sf_dir))
    return rows.select("truth", "pair_count", *[F.round(c, 6).alias(c) for c in ("min", "p25", "median", "p75", "max")])


# --- paired studies ----------------------------------------------------------

_CONDITION_SQL = """SELECT CASE WHEN user_id % 2 = 0 THEN 'single_pass' ELSE 'bounded_adaptive' END AS condition,
    round(avg((event_type <> 'error')::INT), 6) AS answerability_accuracy, round(avg((event_type = 'purchase')::INT), 6) AS answerable_completion_rate,
    round(avg(value), 3) AS mean_total_latency_ms, round(quantile_cont(value, 0.95), 3) AS p95_total_latency_ms FROM events GROUP BY 1"""


def condition_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn(
        "condition", F.when(F.col("user_id") % 2 == 0, "single_pass").otherwise("bounded_adaptive")
    )
    plain = rows.groupBy("condition").agg(
        F.round(F.avg((F.col("event_type") != "error").cast("int")), 6).alias("answerability_accuracy"),
        F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("answerable_completion_rate"),
        F.round(F.avg("value"), 3).alias("mean_total_latency_ms"),
    )
    spread = exact_quantiles(rows, ["condition"], "value", {"p95_total_latency_ms": 0.95})
    return plain.join(spread, "condition").withColumn("p95_total_latency_ms", F.round("p95_total_latency_ms", 3))


_STUDY = ["answerability_accuracy", "answerable_completion_rate", "mean_total_latency_ms", "p95_total_latency_ms"]


@query(
    "condition_deltas",
    f"""WITH r AS ({_CONDITION_SQL}), l AS ({' UNION ALL '.join(f"SELECT condition, '{m}' AS metric, {m} AS v FROM r" for m in _STUDY)})
        SELECT metric, max(v) FILTER (WHERE condition = 'bounded_adaptive') AS treated, max(v) FILTER (WHERE condition = 'single_pass') AS base,
          round(max(v) FILTER (WHERE condition = 'bounded_adaptive') - max(v) FILTER (WHERE condition = 'single_pass'), 6) AS delta FROM l GROUP BY 1""",
)
def condition_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_metrics.condition_deltas(
        condition_reports(spark, sf_dir), "condition", "bounded_adaptive", "single_pass", _STUDY
    )


_STUDY_ROWS = """SELECT user_id, any_value(user_id % 5 <> 0) AS parity,
    avg((event_type = 'error')::INT) FILTER (WHERE event_id % 2 = 0) AS fail_base, avg((event_type = 'error')::INT) FILTER (WHERE event_id % 2 = 1) AS fail_treated,
    avg((event_type <> 'error')::INT) FILTER (WHERE event_id % 2 = 0) AS acc_base, avg((event_type <> 'error')::INT) FILTER (WHERE event_id % 2 = 1) AS acc_treated,
    avg((event_type = 'purchase')::INT) FILTER (WHERE event_id % 2 = 0) AS done_base, avg((event_type = 'purchase')::INT) FILTER (WHERE event_id % 2 = 1) AS done_treated,
    count(*) FILTER (WHERE event_type = 'view' AND event_id % 2 = 1) AS triggers, count(*) FILTER (WHERE event_type = 'signup' AND event_id % 2 = 1) AS recoveries
    FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 2 = 0) > 0 AND count(*) FILTER (WHERE event_id % 2 = 1) > 0"""


@query(
    "study_verdicts",
    f"""WITH s AS ({_STUDY_ROWS}) SELECT user_id, CASE WHEN NOT parity THEN 'baseline_parity_failed' WHEN fail_treated > fail_base THEN 'integrity_regression'
          WHEN acc_treated < acc_base OR done_treated < done_base THEN 'quality_regression'
          WHEN recoveries >= 3 AND (acc_treated > acc_base OR done_treated > done_base) THEN 'benefit_observed'
          WHEN triggers = 0 THEN 'safe_no_recovery_activated' ELSE 'safe_no_measured_benefit' END AS verdict FROM s""",
)
def study_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paired study per user: even events are the baseline, odd ones the treatment."""
    even, kind = F.col("event_id") % 2 == 0, F.col("event_type")

    def mean(flag, side):
        return F.avg(F.when(side, flag.cast("int")))

    def report(side):
        ones = [F.lit(1.0).alias(m) for m in answer_metrics.HIGHER_IS_SAFE]
        return F.struct(
            mean(kind == "error", side).alias("generation_failure_rate"),
            mean(kind != "error", side).alias("answerability_accuracy"),
            mean(kind == "purchase", side).alias("answerable_completion_rate"), F.lit(1.0).alias("expected_term_recall"), *ones,
        )

    pairs = events(spark, sf_dir).groupBy("user_id").agg(
        report(even).alias("base"), report(~even).alias("treated"),
        F.count_if(~even & (kind == "view")).alias("recovery_trigger_count"),
        F.count_if(~even & (kind == "signup")).alias("successful_recovery_count"),
        F.count_if(even).alias("n_base"), F.count_if(~even).alias("n_treated"),
    ).where("n_base > 0 AND n_treated > 0")
    flags = {c: F.lit(True) for c in ("all_traces_valid", "all_provenance_valid", "all_bounds_respected")}
    checked = answer_metrics.safety_checks(pairs.withColumns(flags)).withColumns(
        {"baseline_parity": F.col("user_id") % 5 != 0, "minimum_successful_recoveries": F.lit(3)}
    )
    return answer_metrics.study_verdict(checked).select("user_id", "verdict")


@query(
    "report_mismatches",
    """WITH a AS (SELECT user_id, count(*) AS n, round(avg(value), 3) AS mean_value, min(event_type) AS kind FROM events WHERE event_id % 2 = 0 GROUP BY 1),
       b AS (SELECT user_id, count(*) AS n, round(avg(value), 3) AS mean_value, min(event_type) AS kind FROM events WHERE event_id % 2 = 1 GROUP BY 1)
       SELECT user_id, field FROM (
         SELECT user_id, 'n' AS field, a.n IS NOT DISTINCT FROM b.n AS same FROM a FULL JOIN b USING (user_id)
         UNION ALL SELECT user_id, 'mean_value', coalesce(abs(a.mean_value - b.mean_value) <= 1e-12, a.mean_value IS NOT DISTINCT FROM b.mean_value) FROM a FULL JOIN b USING (user_id)
         UNION ALL SELECT user_id, 'kind', a.kind IS NOT DISTINCT FROM b.kind FROM a FULL JOIN b USING (user_id)) WHERE NOT same""",
)
def report_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def half(parity: int) -> DataFrame:
        return events(spark, sf_dir).where(F.col("event_id") % 2 == parity).groupBy("user_id").agg(
            F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean_value"), F.min("event_type").alias("kind")
        )

    return answer_metrics.report_mismatches(half(0), half(1), "user_id", ["n", "mean_value", "kind"])


# --- agents over conversations ----------------------------------------------

_TURN_SQL = """SELECT conv_id, turn, role, length(text) AS chars, CASE role WHEN 'user' THEN 'hybrid_retrieve' WHEN 'assistant' THEN 'check_evidence_sufficiency' ELSE 'fetch_source_context' END AS tool FROM conversations"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = (
        F.when(F.col("role") == "user", "hybrid_retrieve").when(F.col("role") == "assistant", "check_evidence_sufficiency")
        .otherwise("fetch_source_context")
    )
    return P.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"), tool.alias("tool"))


@query(
    "agent_trajectory_metrics",
    f"""WITH t AS ({_TURN_SQL}), o AS (SELECT conv_id % 3 AS grp, conv_id, list(DISTINCT tool) AS used, count(*) AS calls, sum(chars)::DOUBLE AS lat,
          conv_id % 4 <> 0 AS answerable, CASE WHEN conv_id % 5 = 0 THEN 'grounded_refusal' WHEN conv_id % 7 = 0 THEN 'human_review_required' ELSE 'answer_completed' END AS ended,
          max(chars) > 800 AS retried FROM t GROUP BY conv_id),
        f AS (SELECT *, list_contains(used, 'hybrid_retrieve')::INT + list_contains(used, 'check_evidence_sufficiency')::INT AS covered,
          NOT list_contains(used, 'fetch_source_context') AS clean, CASE WHEN answerable THEN 'answer_completed' ELSE 'grounded_refusal' END AS wanted,
          least(calls, 3) AS n_tools FROM o)
        SELECT grp, count(*) AS case_count,
          round(avg(CASE WHEN answerable THEN (ended = 'answer_completed')::INT ELSE (ended <> 'answer_completed')::INT END), 6) AS task_completion_rate,
          round(avg((ended = wanted)::INT), 6) AS termination_accuracy, round(avg((covered = 2 AND clean)::INT), 6) AS tool_selection_accuracy,
          round(sum(covered) / (2 * count(*)), 6) AS required_tool_recall, round(avg(clean::INT), 6) AS forbidden_tool_avoidance,
          round(avg((len(used) <= 2)::INT), 6) AS tool_budget_compliance,
          round(CASE WHEN count(*) FILTER (WHERE NOT answerable) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (WHERE NOT answerable AND ended = 'grounded_refusal') / count(*) FILTER (WHERE NOT answerable) END, 6) AS safe_refusal_accuracy,
          round(avg(retried::INT), 6) AS retry_case_rate,
          round(CASE WHEN count(*) FILTER (WHERE retried) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (WHERE retried AND conv_id % 2 = 0) / count(*) FILTER (WHERE retried) END, 6) AS recovery_success_rate,
          round(avg((ended = 'human_review_required')::INT), 6) AS human_review_trigger_rate, round(avg(len(used)), 6) AS mean_tool_calls,
          round(avg(lat), 6) AS mean_latency_ms, quantile_cont(lat, 0.5) AS p50_latency_ms,
          list_sort(list(lat))[round_even(0.95 * (count(*) - 1), 0)::BIGINT + 1] AS p95_latency_ms
        FROM f GROUP BY 1""",
)
def agent_trajectory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per conversation: distinct tools, ending, retries and cost."""
    runs = turns(spark, sf_dir).groupBy("conv_id").agg(
        F.array_sort(F.collect_set("tool")).alias("tools_used"),  # at most the registered tools
        F.sum("chars").cast("double").alias("latency_ms"), F.max("chars").alias("longest"),
    )
    ended = (
        F.when(F.col("conv_id") % 5 == 0, "grounded_refusal").when(F.col("conv_id") % 7 == 0, "human_review_required")
        .otherwise("answer_completed")
    )
    rows = runs.select(
        (F.col("conv_id") % 3).alias("grp"), "tools_used", "latency_ms",
        (F.col("conv_id") % 4 != 0).alias("answerable"), ended.alias("termination_reason"),
        F.lit(True).alias("answered"),
        F.when(F.col("conv_id") % 4 != 0, "answer_completed").otherwise("grounded_refusal").alias("expected_termination"),
        F.array(F.lit("hybrid_retrieve"), F.lit("check_evidence_sufficiency")).alias("required_tools"),
        F.array(F.lit("fetch_source_context")).alias("forbidden_tools"), F.lit(2).alias("maximum_tool_calls"),
        (F.col("longest") > 800).cast("int").alias("retry_count"), (F.col("conv_id") % 2 == 0).alias("recovered_after_failure"),
        (ended == "human_review_required").alias("human_review_triggered"),
    )
    return agents.trajectory_metrics(rows, ["grp"])


@query(
    "checkpoint_latest",
    "SELECT conv_id::VARCHAR AS thread_id, turn AS sequence, role, text AS state FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1",
)
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("sequence"), "role", F.col("text").alias("state")
    )
    return agents.latest_checkpoint(rows)


@query(
    "vector_norms",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(
    "index_report",
    "SELECT count(*) AS vector_count, min(len(embedding))::INT AS min_dimension, max(len(embedding))::INT AS max_dimension FROM embeddings",
)
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dimension_report(P.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"))
