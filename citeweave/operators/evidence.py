"""Bounded evidence, sufficiency gate, injection scan, answers and citations.

Evidence of one question is at most the evidence depth (five by default), so it
travels as one array per row and every rule below is an array expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions.metrics import coverage_ratio

REFUSAL = "The supplied evidence is insufficient to answer this question reliably."


@dataclass(frozen=True)
class EvidenceSettings:
    evidence_top_k: int = 5
    minimum_evidence_count: int = 1
    max_context_characters: int = 12000
    max_chunk_characters: int = 3000
    max_claims: int = 6


EVIDENCE_FIELDS = [
    "chunk_id", "document_id", "page_start", "page_end", "citation_url", "source_url", "document_sha256",
]
_ITEM = (
    "struct<evidence_id:string,text:string,rank:int,chunk_id:string,document_id:bigint,page_start:bigint,"
    "page_end:bigint,citation_url:string,source_url:string,document_sha256:string>"
)


def build_evidence(
    hits: DataFrame, queries: DataFrame, settings: EvidenceSettings = EvidenceSettings()
) -> DataFrame:
    """One row per query with the folded evidence array ``E1..En``.

    ``hits`` carries the chunk text and the evidence fields (see ``rerank``).

    The fold is ordered: the trimmed length of an item decides how much room the
    next one has, so it runs as ``aggregate`` over the rank-sorted hits.
    """
    rows = hits.where(F.col("rank") <= settings.evidence_top_k).select("query_id", "rank", "text", *EVIDENCE_FIELDS)
    grouped = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", *EVIDENCE_FIELDS))).alias("hits")
    )
    empty = F.array().cast(f"array<{_ITEM}>")

    def step(acc: Column, hit: Column) -> Column:
        room = F.least(F.lit(settings.max_chunk_characters), settings.max_context_characters - acc["used"])
        cut = T.strip(F.substring(hit["text"], F.lit(1), room))
        item = F.struct(
            F.concat(F.lit("E"), (F.size(acc["items"]) + 1).cast("string")).alias("evidence_id"),
            cut.alias("text"), hit["rank"].cast("int").alias("rank"),
            *[hit[f].alias(f) for f in EVIDENCE_FIELDS],
        ).cast(_ITEM)
        skip = (room <= 0) | (cut == "")
        return F.struct(
            F.when(skip, acc["used"]).otherwise(acc["used"] + F.length(cut)).alias("used"),
            F.when(skip, acc["items"]).otherwise(F.concat(acc["items"], F.array(item))).alias("items"),
        )

    start = F.struct(F.lit(0).alias("used"), empty.alias("items"))
    folded = grouped.select(
        "query_id", F.size("hits").alias("returned_count"),
        F.aggregate("hits", start, step).alias("fold"),
    ).select(
        "query_id", "returned_count", F.col("fold.used").alias("used_characters"),
        F.col("fold.items").alias("evidence"),
    )
    return queries.select("query_id", "query").join(folded, "query_id", "left").select(
        "query_id", "query",
        F.coalesce("returned_count", F.lit(0)).alias("returned_count"),
        F.coalesce("used_characters", F.lit(0)).alias("used_characters"),
        F.coalesce("evidence", empty).alias("evidence"),
    )


@dataclass(frozen=True)
class SufficiencyProfile:
    minimum_evidence_count: int = 1
    minimum_supported_terms: int = 2
    minimum_query_term_coverage: float = 0.60
    minimum_single_evidence_coverage: float = 0.35
    exact_query_minimum_coverage: float = 0.75
    require_all_numeric_terms: bool = True
    require_named_anchors: bool = True
    require_claim_qualifiers: bool = False
    require_scope_qualifiers: bool = False

    def __post_init__(self) -> None:
        if self.exact_query_minimum_coverage < self.minimum_query_term_coverage:
            raise ValueError("exact-query coverage must not be below the general minimum")


PROFILES = {
    "v0.1": SufficiencyProfile(),
    "v0.2": SufficiencyProfile(require_claim_qualifiers=True),
    "v0.2.1": SufficiencyProfile(require_claim_qualifiers=True),
    "v0.3.0": SufficiencyProfile(require_claim_qualifiers=True, require_scope_qualifiers=True),
}


def assess(df: DataFrame, profile: SufficiencyProfile = SufficiencyProfile(), query: str = "query") -> DataFrame:
    """Add the auditable sufficiency decision to rows with ``evidence``.

    ``query`` names the question the evidence is judged against; a recovery pass
    retrieves with a rewritten query but is judged against the original one.
    """
    asked = T.strip(F.col(query))
    texts = F.filter("evidence.text", lambda t: T.strip(t) != "")
    staged = df.withColumn("evidence_terms", F.transform(texts, lambda t: F.array_distinct(T.stemmed_tokens(t))))
    staged = staged.withColumns(
        {
            "union_terms": F.array_distinct(F.flatten("evidence_terms")),
            "query_terms": T.informative_terms(asked),
            "required_numeric_terms": T.numeric_terms(asked),
            "required_named_anchors": T.named_anchors(asked),
            "required_claim_qualifiers": T.claim_qualifiers(asked),
            "required_scope_qualifiers": T.scope_qualifiers(asked),
            "union_scopes": F.flatten(F.transform(texts, T.scope_qualifiers)),
        }
    )
    known = F.col("union_terms")
    staged = staged.withColumns(
        {
            "supported_terms": F.array_intersect("query_terms", known),
            "unsupported_terms": F.array_except("query_terms", known),
            "supported_numeric_terms": F.array_intersect("required_numeric_terms", known),
            "supported_named_anchors": F.array_intersect("required_named_anchors", known),
            "supported_claim_qualifiers": F.array_intersect("required_claim_qualifiers", known),
            "supported_scope_qualifiers": F.array_intersect("required_scope_qualifiers", "union_scopes"),
            "best_overlap": F.coalesce(
                F.array_max(
                    F.transform("evidence_terms", lambda e: F.size(F.array_intersect(F.col("query_terms"), e)))
                ),
                F.lit(0),
            ),
            "evidence_count": F.size("evidence_terms"),
        }
    )
    terms = F.size("query_terms")
    staged = staged.withColumns(
        {
            "query_term_coverage": coverage_ratio(F.size("supported_terms"), terms),
            "single_evidence_coverage": coverage_ratio(F.col("best_overlap"), terms),
        }
    )
    needed = F.when(
        F.array_contains("query_terms", "exact"), profile.exact_query_minimum_coverage
    ).otherwise(profile.minimum_query_term_coverage)

    def missing(kind: str) -> Column:
        return F.size(f"required_{kind}") != F.size(f"supported_{kind}")

    rules: list[tuple[str, Column]] = [
        ("insufficient_evidence_count", F.col("evidence_count") < profile.minimum_evidence_count),
        ("no_informative_query_terms", terms == 0),
        ("insufficient_supported_terms", F.size("supported_terms") < profile.minimum_supported_terms),
        ("low_query_term_coverage", F.col("query_term_coverage") < needed),
        (
            "low_single_evidence_coverage",
            F.col("single_evidence_coverage") < profile.minimum_single_evidence_coverage,
        ),
    ]
    optional = [
        (profile.require_all_numeric_terms, "missing_numeric_support", "numeric_terms"),
        (profile.require_named_anchors, "missing_named_anchor_support", "named_anchors"),
        (profile.require_claim_qualifiers, "missing_claim_qualifier_support", "claim_qualifiers"),
        (profile.require_scope_qualifiers, "missing_scope_qualifier_support", "scope_qualifiers"),
    ]
    rules += [(code, missing(kind)) for wanted, code, kind in optional if wanted]
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))
    return (
        staged.withColumn("reasons", reasons)
        .withColumn("sufficient", F.size("reasons") == 0)
        .drop("evidence_terms", "union_terms", "union_scopes", "best_overlap")
    )


# Instruction-like patterns searched in evidence, matched without case.
INJECTION_RULES = {
    "ignore_instructions": r"\bignore\s+(?:all\s+)?(?:previous|prior|system|developer)\s+instructions?\b",
    "override_system_prompt": r"\b(?:override|replace|change)\s+(?:the\s+)?system\s+prompt\b",
    "reveal_hidden_prompt": r"\b(?:reveal|show|print|expose)\s+(?:the\s+)?(?:hidden\s+)?(?:system|developer)\s+(?:prompt|message|instructions?)\b",
    "developer_message": r"\bdeveloper\s+message\b",
    "tool_execution": r"\b(?:execute|run|call)\s+(?:this\s+)?(?:tool|command|shell|code)\b",
    "role_reassignment": r"\byou\s+are\s+now\b",
}


def injection_findings(texts: DataFrame, rules: dict[str, str] = INJECTION_RULES) -> DataFrame:
    """One row per (evidence, rule) that matches, with the first matched text.

    The rules are a handful of literal patterns evaluated side by side on the
    row; the table itself is neither joined nor shuffled.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule_id"),
                F.regexp_substr(F.col("text"), F.lit(f"(?i){pattern}")).alias("matched_text"),
            )
            for rule, pattern in rules.items()
        ]
    )
    return texts.select(
        "evidence_id", F.explode(F.filter(found, lambda f: f["matched_text"].isNotNull())).alias("f")
    ).select("evidence_id", "f.rule_id", "f.matched_text")


def injection_policy(texts: DataFrame, block: bool, rules: dict[str, str] = INJECTION_RULES) -> DataFrame:
    """Per evidence row: matched rule ids and whether the row is let through."""
    matched = F.array_sort(
        F.array_compact(
            F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.lit(r)) for r, p in rules.items()])
        )
    )
    staged = texts.select("evidence_id", matched.alias("rule_ids"))
    safe = F.size("rule_ids") == 0
    return staged.withColumn("safe", safe).withColumn("passed", safe if block else F.lit(True))


def extractive_response(df: DataFrame, max_claims: int = 6, maximum_characters: int = 420) -> DataFrame:
    """Deterministic answer: one cited statement per evidence item."""
    claims = F.transform(
        F.slice("evidence", 1, max_claims),
        lambda e: F.struct(
            T.extract_statement(e["text"], maximum_characters).alias("text"),
            F.array(e["evidence_id"]).alias("evidence_ids"),
        ),
    )
    return df.withColumn("claims", claims).withColumn(
        "answer",
        F.when(F.size("claims") > 0, F.array_join("claims.text", " ")).otherwise(F.lit(REFUSAL)),
    )


def response_problems(df: DataFrame, max_claims: int = 6) -> DataFrame:
    """Contract violations of a provider response, as codes per row."""
    cited = F.flatten("claims.evidence_ids")
    doubled = F.exists("claims", lambda c: F.size(F.array_distinct(c["evidence_ids"])) < F.size(c["evidence_ids"]))
    uncited = F.exists("claims", lambda c: F.size(c["evidence_ids"]) == 0)
    codes = [
        ("too_many_claims", F.size("claims") > max_claims),
        ("unknown_evidence", F.size(F.array_except(cited, "evidence.evidence_id")) > 0),
        ("duplicate_evidence", doubled),
        ("uncited_claim", uncited),
    ]
    return df.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in codes])))


def dedupe_claim_evidence(claims: Column) -> Column:
    """Order-preserving removal of repeated evidence ids inside each claim."""
    return F.transform(
        claims,
        lambda c: F.struct(c["text"].alias("text"), F.array_distinct(c["evidence_ids"]).alias("evidence_ids")),
    )


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def resolve_citations(df: DataFrame) -> DataFrame:
    """Citation ids in first-reference order plus source documents.

    ``claims[].evidence_ids`` refer to ``evidence``; the order of first mention
    numbers citations C1, C2, ... and orders the source documents. Readers that
    unnest the arrays should use the outer explode: the inner one makes Spark
    push a size test, and with it all of these expressions, to the scan again.
    """
    order = F.array_distinct(F.flatten("claims.evidence_ids"))
    items = F.transform(
        "cited", lambda e: F.element_at(F.filter("evidence", lambda x: x["evidence_id"] == e), 1)
    )
    citations = F.transform(
        "cited_items",
        lambda x, i: F.struct(
            F.concat(F.lit("C"), (i + 1).cast("string")).alias("citation_id"),
            x["evidence_id"].alias("evidence_id"),
            *[x[f].alias(f) for f in EVIDENCE_FIELDS],
            x["rank"].alias("reranker_rank"),
        ),
    )
    staged = df.withColumn("cited", order).withColumn("cited_items", items).withColumn("citations", citations)
    claims = F.transform(
        "claims",
        lambda c, i: F.struct(
            F.concat(F.lit("CL"), (i + 1).cast("string")).alias("claim_id"),
            c["text"].alias("text"),
            F.transform(
                c["evidence_ids"],
                lambda e: F.concat(F.lit("C"), F.array_position("cited", e).cast("string")),
            ).alias("citation_ids"),
        ),
    )
    documents = F.transform(
        F.array_distinct("citations.document_id"),
        lambda d: F.struct(
            d.alias("document_id"),
            F.array_distinct(
                F.transform(
                    F.filter("citations", lambda c: c["document_id"] == d),
                    lambda c: page_range(c["page_start"], c["page_end"]),
                )
            ).alias("page_ranges"),
            F.array_distinct(
                F.transform(F.filter("citations", lambda c: c["document_id"] == d), lambda c: c["chunk_id"])
            ).alias("chunk_ids"),
        ),
    )
    return staged.withColumns({"claims": claims, "source_documents": documents}).drop("cited", "cited_items")


def grounded_answers(assessed: DataFrame, settings: EvidenceSettings = EvidenceSettings()) -> DataFrame:
    """Final answers: gate first, answer only what passes, refuse the rest.

    The gate empties the evidence before the answer step, so a model-backed
    generator placed there is never called for refused questions.
    """
    nothing = F.filter("evidence", lambda _: F.lit(False))
    gated = assessed.withColumn(
        "evidence", F.when(F.col("sufficient"), F.col("evidence")).otherwise(nothing)
    )
    answered = resolve_citations(extractive_response(gated, settings.max_claims))
    return answered.withColumn("insufficient_evidence", ~F.col("sufficient"))


def query_log_fields(answers: DataFrame) -> DataFrame:
    """Flat log columns of nested answers."""
    return answers.select(
        "query_id", "sufficient", "evidence_count", "query_term_coverage", "single_evidence_coverage",
        F.size("claims").alias("claim_count"), F.size("citations").alias("citation_count"),
        F.size("source_documents").alias("source_document_count"),
        F.array_join("reasons", ",").alias("reasons"),
        "insufficient_evidence", F.col("insufficient_evidence").alias("provider_bypassed"),
    )
