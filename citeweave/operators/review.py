"""Human review: concept coverage, auto labels, review units, adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions.hashing import fingerprint
from citeweave.functions.metrics import ratio_or
from citeweave.operators.scale import global_row_number


def concept_matches(answers: DataFrame, concepts: DataFrame) -> DataFrame:
    """First accepted phrase of each concept found in the normalized answer.

    ``concepts(query_id, concept_id, canonical_text, accepted_phrases)``; the
    canonical text is tried before its aliases.
    """
    normalized = T.normalize_semantic_text(F.col("answer"))
    tried = F.concat(F.array("canonical_text"), F.col("accepted_phrases"))
    joined = concepts.join(answers.select("query_id", normalized.alias("normalized_answer")), "query_id")
    found = F.filter(tried, lambda p: F.contains(F.col("normalized_answer"), T.normalize_semantic_text(p)))
    staged = joined.select(
        "query_id", "concept_id", "canonical_text", F.try_element_at(found, F.lit(1)).alias("matched_phrase")
    )
    return staged.select(
        "query_id", "concept_id", F.col("matched_phrase").isNotNull().alias("matched"),
        F.when(F.col("matched_phrase") == F.col("canonical_text"), "canonical")
        .when(F.col("matched_phrase").isNotNull(), "alias").alias("match_method"),
        "matched_phrase",
    )


def concept_coverage(matches: DataFrame) -> DataFrame:
    return matches.groupBy("query_id").agg(
        F.count("*").alias("concept_count"), F.count_if(F.col("matched")).alias("matched_concept_count")
    ).withColumn("semantic_concept_coverage", F.round(F.col("matched_concept_count") / F.col("concept_count"), 6))


def exact_support(claim: Column, evidence: Column) -> Column:
    """The whole normalized claim occurs in one normalized evidence text."""
    wanted = T.normalize_semantic_text(claim)
    return (wanted != "") & F.exists(evidence, lambda e: F.contains(T.normalize_semantic_text(e), wanted))


def redundancy_status(answers: DataFrame) -> DataFrame:
    """Single-claim answers are distinct by construction, others need review."""
    return answers.select(
        "query_id",
        F.posexplode_outer("claims").alias("pos", "claim"),
        F.when(F.size("claims") == 1, "AUTO_DISTINCT_SINGLETON").otherwise("REVIEW_REQUIRED").alias("review_status"),
    ).where("pos IS NOT NULL").select("query_id", (F.col("pos") + 1).alias("claim_no"), "claim.text", "review_status")


def _task(pending: DataFrame, parts: list[str]) -> Column:
    return fingerprint(F.struct(*parts), pending.select(*parts).schema)


def review_units(pending: DataFrame, parts: list[str], batch_size: int = 25) -> DataFrame:
    """Identical review tasks merged into numbered units and batches.

    Members of a unit are counted, with the smallest id as representative; the
    member list itself is the (fingerprint, review_id) relation, so a task
    repeated millions of times does not become one array. Numbering follows the
    fingerprint order over 256 even digest buckets.
    """
    keyed = pending.withColumn("fingerprint", _task(pending, parts))
    units = keyed.groupBy("fingerprint").agg(
        F.count("*").alias("member_count"), F.min("review_id").alias("first_review_id")
    )
    numbered = global_row_number(
        units, F.substring("fingerprint", 1, 2), [F.col("fingerprint")], "unit_no"
    )
    return numbered.select(
        F.format_string("unit_%03d", "unit_no").alias("unit_id"), "fingerprint", "member_count",
        "first_review_id", (F.floor((F.col("unit_no") - 1) / batch_size) + 1).alias("batch_no"),
    )


def unit_members(pending: DataFrame, units: DataFrame, parts: list[str]) -> DataFrame:
    keyed = pending.select("review_id", _task(pending, parts).alias("fingerprint"))
    return keyed.join(units.select("unit_id", "fingerprint"), "fingerprint").select("unit_id", "review_id")


def adjudicate(queue: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Final label per queue row: automatic where present, else the unit's decision."""
    decided = members.join(decisions.select("unit_id", "human_label"), "unit_id")
    return queue.join(decided, "review_id", "left").withColumn(
        "final_label", F.coalesce("automatic_label", "human_label")
    )


def adjudication_gaps(queue: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending rows without decision and decisions of unknown units."""
    pending = queue.where(F.col("automatic_label").isNull()).select("review_id")
    covered = members.join(decisions.select("unit_id"), "unit_id", "left_semi")
    missing = pending.join(covered, "review_id", "left_anti").select(
        F.col("review_id").alias("ref"), F.lit("undecided_row").alias("problem")
    )
    stray = decisions.join(members, "unit_id", "left_anti").select(
        F.col("unit_id").alias("ref"), F.lit("unknown_unit").alias("problem")
    )
    return missing.unionByName(stray)


def label_rates(rows: DataFrame, by: str, labels: list[str], rates: dict[str, list[str]]) -> DataFrame:
    """Label counts and rates per system plus the overall row (null system).

    One pass with grouping sets gives "per system" and "overall" together.
    """
    counts = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("final_label") == l).alias(l.lower()) for l in labels]
    )
    sums = {
        name: F.round(sum((F.col(l.lower()) for l in parts), F.lit(0)) / F.col("total"), 6)
        for name, parts in rates.items()
    }
    return counts.withColumns(sums)


def coverage_bounds(rows: DataFrame, by: str) -> DataFrame:
    """Concept coverage per system: micro and macro, lower and upper bound.

    AMBIGUOUS counts only for the upper bound.
    """
    present = F.count_if(F.col("final_label") == "PRESENT")
    ambiguous = F.count_if(F.col("final_label") == "AMBIGUOUS")
    per_query = rows.groupBy(by, "query_id").agg(
        F.count("*").alias("n"), present.alias("present"), ambiguous.alias("ambiguous")
    ).withColumns(
        {
            "low": ratio_or(F.col("present"), F.col("n"), 0.0),
            "high": ratio_or(F.col("present") + F.col("ambiguous"), F.col("n"), 0.0),
        }
    )
    return per_query.groupBy(by).agg(
        F.sum("n").alias("concept_count"), F.sum("present").alias("present_count"),
        F.sum("ambiguous").alias("ambiguous_count"),
        F.round(F.avg("low"), 6).alias("macro_lower"), F.round(F.avg("high"), 6).alias("macro_upper"),
    ).withColumns(
        {
            "micro_lower": F.round(ratio_or(F.col("present_count"), F.col("concept_count"), 0.0), 6),
            "micro_upper": F.round(
                ratio_or(F.col("present_count") + F.col("ambiguous_count"), F.col("concept_count"), 0.0), 6
            ),
        }
    )


def annotator_agreement(responses: DataFrame, first: str, second: str) -> DataFrame:
    """Exact agreement of two annotators over shared tasks."""
    left = responses.where(F.col("annotator_id") == first).select("task_id", F.col("decision").alias("a"))
    right = responses.where(F.col("annotator_id") == second).select("task_id", F.col("decision").alias("b"))
    return left.join(right, "task_id").agg(
        F.count("*").alias("comparable_task_count"),
        F.count_if(F.col("a") == F.col("b")).alias("exact_match_count"),
        F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("exact_match_rate"),
        F.count_if(F.col("a") != F.col("b")).alias("disagreement_count"),
    ).withColumn("adjudication_required", F.col("disagreement_count") > 0)


def decision_counts(responses: DataFrame, decisions: list[str]) -> DataFrame:
    """Zero-filled decision counts per annotator."""
    return responses.groupBy("annotator_id").agg(
        *[F.count_if(F.col("decision") == d).alias(d) for d in decisions]
    )


def review_gaps(tasks: DataFrame, responses: DataFrame, annotators: list[str]) -> DataFrame:
    """Tasks an annotator has not answered and answers to unknown tasks."""
    expected = tasks.select("task_id", F.explode(F.array(*[F.lit(a) for a in annotators])).alias("annotator_id"))
    given = responses.select("task_id", "annotator_id")
    return expected.exceptAll(given).withColumn("problem", F.lit("missing")).unionByName(
        given.exceptAll(expected).withColumn("problem", F.lit("unexpected"))
    )
