"""Two-pass retrieval: retry only the questions whose evidence falls short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import evidence as E
from citeweave.session import ensure_checkpoint_dir

Retrieve = Callable[[DataFrame], DataFrame]

FIRST_STATES = ["retrieve_initial", "assess_initial"]
SECOND_STATES = ["rewrite_query", "retrieve_recovery", "assess_recovery"]


def run(
    queries: DataFrame,
    retrieve: Retrieve,
    profile: E.SufficiencyProfile = E.SufficiencyProfile(),
    settings: E.EvidenceSettings = E.EvidenceSettings(),
) -> DataFrame:
    """Assessed evidence of the last attempt with the state trace per query.

    Pass two sees only the insufficient questions; it retrieves with the
    rewritten query and is judged against the original one. The first pass is
    checkpointed because both branches read it.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    first = E.assess(E.build_evidence(retrieve(queries), queries, settings), profile).checkpoint()
    retry = first.where(~F.col("sufficient")).select(
        "query_id", F.col("query").alias("original_query"), T.rewrite_query(F.col("query")).alias("query")
    )
    recovered = E.build_evidence(retrieve(retry), retry, settings).join(
        retry.select("query_id", "original_query"), "query_id"
    )
    second = E.assess(recovered, profile, query="original_query")
    end = F.when(F.col("sufficient"), F.lit("generate")).otherwise(F.lit("grounded_refusal"))

    def states(names: list[str]):
        return F.concat(F.array(*[F.lit(n) for n in names]), F.array(end))

    shown = [
        "query_id", "evidence", "returned_count", "evidence_count", "query_term_coverage",
        "single_evidence_coverage", "reasons", "sufficient",
    ]
    once = first.where("sufficient").select(
        *shown, "query", F.lit(None).cast("string").alias("rewritten_query"), F.lit(1).alias("attempts"),
        states(FIRST_STATES).alias("states"),
    )
    twice = second.select(
        *shown, F.col("original_query").alias("query"), F.col("query").alias("rewritten_query"),
        F.lit(2).alias("attempts"), states(FIRST_STATES + SECOND_STATES).alias("states"),
    )
    return once.unionByName(twice)


def invalid_traces(traces: DataFrame, maximum_attempts: int = 2) -> DataFrame:
    """Traces that are neither of the two legal state sequences."""
    end = F.when(F.col("sufficient"), F.lit("generate")).otherwise(F.lit("grounded_refusal"))
    one = F.concat(F.array(*[F.lit(s) for s in FIRST_STATES]), F.array(end))
    two = F.concat(F.array(*[F.lit(s) for s in FIRST_STATES + SECOND_STATES]), F.array(end))
    legal = F.when(F.col("attempts") == 1, (F.col("states") == one) & F.col("rewritten_query").isNull()).otherwise(
        (F.col("states") == two) & F.col("rewritten_query").isNotNull()
    )
    return traces.where(~legal | (F.col("attempts") > maximum_attempts)).select("query_id", "states", "attempts")
