"""Paired study of two retrieval conditions over the same questions: traces, bounds, reports and differences.

A trace is an ordered list of states and the attempts made. An automaton reads the states; attempts, provenance and
timings are checked beside it. Everything is an expression per row, reports are aggregations, and the two conditions
meet in one equi-join on the question.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.rules import Check, Rule, each, filled, holds, violations, when
from citeweave.operators.scale import exact_quantiles

# States of a bounded recovery and what may follow each.
NEXT_STATES = {
    "start": ["retrieve_initial"],
    "retrieve_initial": ["assess_initial"],
    "assess_initial": ["rewrite_query", "generate", "grounded_refusal"],
    "rewrite_query": ["retrieve_recovery"],
    "retrieve_recovery": ["assess_recovery"],
    "assess_recovery": ["generate", "grounded_refusal"],
}
ENDS = ["generate", "grounded_refusal"]


class Bounds(NamedTuple):
    passes: int = 2
    rewrites: int = 1


def final_state(states: Column, moves: dict[str, list[str]] | None = None) -> Column:
    """State of the automaton after all of ``states``, null as soon as a step is not allowed or there is none."""
    moves = NEXT_STATES if moves is None else moves
    allowed = F.map_from_entries(F.array(*[
        F.struct(F.lit(s).alias("k"), F.array(*[F.lit(n) for n in following]).alias("v")) for s, following in moves.items()
    ]))
    end = F.aggregate(
        states, F.lit("start"), lambda at, s: F.when(F.array_contains(F.try_element_at(allowed, at), s), s).otherwise(F.lit(None).cast("string"))
    )
    return F.when(end != "start", end)


def trace_rules(bounds: Bounds = Bounds()) -> list[Rule]:
    """Rules of an adaptive answer with a trace.

    Columns: original_query, rewritten_query, states, attempts(attempt_number, retrieval_query, returned_evidence_count,
    used_evidence_count, sufficient, provenance(attempt_number, chunk_id, citation_url, source_url, document_sha256)),
    terminal_state, insufficient_evidence, retrieval_attempt_count, query_rewrite_count (both null without timings).
    """
    attempts, states, last = F.col("attempts"), F.col("states"), F.col("terminal_state")
    rewritten = F.col("rewritten_query")
    made, again = F.size(attempts), F.size(attempts) == 2
    rewrites = rewritten.isNotNull().cast("int")
    timed = F.col("retrieval_attempt_count").isNotNull() & F.col("query_rewrite_count").isNotNull()
    first, second = F.get(attempts, F.lit(0)), F.get(attempts, F.lit(1))
    ends_well = F.element_at(attempts, -1)["sufficient"] == (last == "generate")

    def sourced(p: Column) -> Check:
        names = ("chunk_id", "citation_url", "source_url", "document_sha256")
        missing = F.concat_ws("+", *[F.when(filled(p[f]).broken, F.lit(f)) for f in names])
        return holds(missing == "", missing)

    def own(a: Column, check) -> Check:
        return each(a["provenance"], check)

    return [
        Rule("states_broken", holds(F.coalesce(final_state(states).eqNullSafe(last), F.lit(False)) & last.isin(*ENDS), F.array_join(states, ">"))),
        Rule("attempts_not_consecutive", holds((made >= 1) & (attempts["attempt_number"] == F.sequence(F.lit(1), F.greatest(made, F.lit(1)))), made)),
        Rule("states_and_attempts_differ", holds(F.array_contains(states, "rewrite_query") == again, made)),
        Rule("single_pass_rewrites", when(made == 1, holds(rewritten.isNull()))),
        Rule("recovery_after_success", when(again, holds(~first["sufficient"]))),
        Rule("recovery_without_rewrite", when(again, holds(rewritten.isNotNull()))),
        Rule("recovery_asks_otherwise", when(again & rewritten.isNotNull(), holds(second["retrieval_query"] == rewritten))),
        Rule("end_contradicts_assessment", when(made >= 1, holds(ends_well))),
        Rule("end_contradicts_answer", holds((last == "generate") == ~F.col("insufficient_evidence"))),
        Rule("timings_differ", when(timed, holds((F.col("retrieval_attempt_count") == made) & (F.col("query_rewrite_count") == rewrites)))),
        Rule("provenance_count", each(attempts, lambda a: holds(a["returned_evidence_count"] == F.size(a["provenance"])))),
        Rule("provenance_used", each(attempts, lambda a: holds(a["used_evidence_count"] <= a["returned_evidence_count"]))),
        Rule("provenance_attempt", each(attempts, lambda a: own(a, lambda p: holds(p["attempt_number"] == a["attempt_number"])))),
        Rule("provenance_source", each(attempts, lambda a: own(a, sourced))),
        Rule("bound_passes", holds(F.greatest(made, F.coalesce("retrieval_attempt_count", F.lit(0))) <= bounds.passes, made)),
        Rule("bound_rewrites", holds(F.greatest(rewrites, F.coalesce("query_rewrite_count", F.lit(0))) <= bounds.rewrites)),
    ]


def diagnostics(answers: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """(query_id, generation_failed, timings, counts and verdicts) of adaptive answers; a row without states has no trace.

    ``answers``: query_id, generation_failed, total_latency_ms, retrieval_ms, evidence_build_ms and the columns of
    ``trace_rules``. Verdicts are null for failed answers, and false for answers without a trace.
    """
    rules = trace_rules(bounds)
    there = F.col("states").isNotNull() & F.col("attempts").isNotNull()

    def verdict(prefix: tuple[str, ...], inside: bool = True) -> Column:
        good = F.lit(True)
        for r in rules:
            if r.name.startswith(prefix) == inside:
                good = good & ~r.check.broken
        return F.when(~F.col("generation_failed"), there & good)

    recovered = F.coalesce(~F.col("generation_failed") & there & (F.size("attempts") == 2), F.lit(False))
    return answers.select(
        "query_id", "generation_failed", "total_latency_ms", "retrieval_ms", "evidence_build_ms", "retrieval_attempt_count", "query_rewrite_count",
        (~F.col("generation_failed") & ~there).alias("missing_trace"),
        verdict(("provenance_", "bound_"), False).alias("trace_valid"), verdict(("provenance_",)).alias("provenance_valid"),
        verdict(("bound_",)).alias("bounds_respected"), recovered.alias("recovery_triggered"),
        (recovered & F.coalesce(F.col("terminal_state") == "generate", F.lit(False))).alias("recovery_succeeded"),
        (recovered & F.coalesce(F.col("terminal_state") == "grounded_refusal", F.lit(False))).alias("recovery_grounded_refusal"),
    )


def trace_violations(answers: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """(query_id, check_name, detail) of the completed answers that carry a trace."""
    rows = answers.where(~F.col("generation_failed") & F.col("states").isNotNull() & F.col("attempts").isNotNull())
    return violations(rows, "query_id", trace_rules(bounds))


def single_pass_diagnostics(answers: DataFrame) -> DataFrame:
    """Diagnostics of the condition without recovery: timings as they are, no trace to judge."""
    none = F.lit(None).cast("boolean")
    return answers.select(
        "query_id", "generation_failed", "total_latency_ms", "retrieval_ms", "evidence_build_ms", "retrieval_attempt_count", "query_rewrite_count",
        F.lit(False).alias("missing_trace"), *[none.alias(n) for n in ("trace_valid", "provenance_valid", "bounds_respected")],
        *[F.lit(False).alias(n) for n in ("recovery_triggered", "recovery_succeeded", "recovery_grounded_refusal")],
    )


LATENCIES = ["mean_total_latency_ms", "p95_total_latency_ms", "mean_retrieval_ms", "p95_retrieval_ms", "mean_evidence_build_ms", "mean_retrieval_attempt_count"]


def condition_report(rows: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Counts and latencies per condition over ``diagnostics`` rows; latencies are those of completed answers."""
    keys = list(keys)
    done = ~F.col("generation_failed")

    def n(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("query_count"), F.coalesce(F.sum(F.when(done, F.col("retrieval_attempt_count"))), F.lit(0)).alias("total_retrieval_attempts"),
        F.coalesce(F.sum(F.when(done, F.col("query_rewrite_count"))), F.lit(0)).alias("total_query_rewrites"),
        n(F.col("recovery_triggered")).alias("recovery_trigger_count"), n(F.col("recovery_succeeded")).alias("successful_recovery_count"),
        n(F.col("recovery_grounded_refusal")).alias("recovery_grounded_refusal_count"), n(F.col("missing_trace")).alias("missing_trace_count"),
        n(~F.col("trace_valid")).alias("invalid_trace_count"), n(~F.col("provenance_valid")).alias("invalid_provenance_count"),
        n(~F.col("bounds_respected")).alias("bound_violation_count"),
        *[
            F.avg(F.when(done, F.col(c))).alias(f"mean_{c}")
            for c in ("total_latency_ms", "retrieval_ms", "evidence_build_ms", "retrieval_attempt_count")
        ],
    )
    completed = rows.where(done)
    for column in ("total_latency_ms", "retrieval_ms"):
        wanted = {f"p50_{column}": 0.5, f"p95_{column}": 0.95}
        counts = counts.join(exact_quantiles(completed, keys, column, wanted), keys, "left")
    return counts


def paired_questions(base: DataFrame, treated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(query_id, paired, column differences treated minus base) over the questions of either side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", F.lit(True).alias(f"__{name}"), *[F.col(c).cast("double").alias(f"__{name}_{c}") for c in columns])

    both = side(base, "b").join(side(treated, "t"), "query_id", "full")
    paired = F.col("__b").isNotNull() & F.col("__t").isNotNull()
    return both.select("query_id", paired.alias("paired"), *[(F.col(f"__t_{c}") - F.col(f"__b_{c}")).alias(f"{c}_delta") for c in columns])


def query_set_problems(queries: DataFrame, answerable: int, unanswerable: int) -> DataFrame:
    """(check_name, detail) where a question set has not the frozen numbers of both kinds."""
    counted = queries.agg(F.count_if("expected_answerable").alias("a"), F.count_if(~F.col("expected_answerable")).alias("u"))
    found = F.array_compact(F.array(
        F.when(F.col("a") + F.col("u") != answerable + unanswerable, F.struct(F.lit("query_count").alias("check_name"), (F.col("a") + F.col("u")).cast("string").alias("detail"))),
        F.when(F.col("a") != answerable, F.struct(F.lit("answerable_count").alias("check_name"), F.col("a").cast("string").alias("detail"))),
        F.when(F.col("u") != unanswerable, F.struct(F.lit("unanswerable_count").alias("check_name"), F.col("u").cast("string").alias("detail"))),
    ))
    return counted.select(F.explode(found).alias("f")).select("f.check_name", "f.detail")
