"""Manifests of evidence that training must not touch, and their consistency at any number of manifests.

A manifest lists its documents and chunks and, per query, the evidence retrieved for it. Whether the lists equal
the union over the queries is decided id by id in one exchange of both sides, and only what breaks a rule is kept.
``differing_sets`` tells which sets differ without the ids, by fingerprints: count, sum and exclusive-or of the hashes
of distinct ids, which combine map-side and do not collect a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.integrity import all_of
from citeweave.session import stored

KEYS = ["manifest_id", "kind"]


def build(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, expected_answerable, document_ids, chunk_ids) from ``hits(query_id, rank, chunk_id, document_id)``.

    Chunks keep their rank order, documents are sorted; a list has at most as many entries as a query has hits.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    lists = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_set("document_id")).alias("document_ids"), ranked["chunk_id"].alias("chunk_ids")
    )
    none = F.array().cast(lists.schema["document_ids"].dataType), F.array().cast(lists.schema["chunk_ids"].dataType)
    return asked.select("query_id", "expected_answerable").join(lists, "query_id", "left").select(
        "query_id", "expected_answerable", F.coalesce("document_ids", none[0]).alias("document_ids"),
        F.coalesce("chunk_ids", none[1]).alias("chunk_ids"),
    )


def members(entries: DataFrame) -> DataFrame:
    """(kind, id) of everything that ``build`` protects, each once."""
    documents, chunks = (
        entries.select(F.lit(kind).alias("kind"), F.explode(F.col(name).cast("array<string>")).alias("id"))
        for kind, name in (("document", "document_ids"), ("chunk", "chunk_ids"))
    )
    return documents.unionByName(chunks).distinct()


def fingerprint(value: str) -> Column:
    """Mergeable fingerprint of the set of distinct values in a group of distinct rows."""
    digest = F.xxhash64(F.lit("set"), value)
    return F.struct(
        F.count("*").alias("n"), F.sum(digest.cast("decimal(38,0)")).alias("total"), F.bit_xor(digest).alias("mask")
    ).alias("fingerprint")


def differing_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Groups (manifest_id, kind) whose sets of ids differ; both sides have distinct rows."""
    l = left.groupBy(*KEYS).agg(fingerprint("id")).withColumnRenamed("fingerprint", "l")
    r = right.groupBy(*KEYS).agg(fingerprint("id")).withColumnRenamed("fingerprint", "r")
    return l.join(r, KEYS, "full").where(~F.col("l").eqNullSafe(F.col("r"))).select(*KEYS)


def violations(headers: DataFrame, queries: DataFrame, refs: DataFrame, listed: DataFrame) -> DataFrame:
    """(manifest_id, check_name, row_key, detail), one row per broken rule.

    ``headers(manifest_id, query_count, document_count, chunk_count, evidence_top_k)``, ``queries(manifest_id,
    query_id)``, ``refs(manifest_id, query_id, kind, id)`` and ``listed(manifest_id, kind, id)`` with kind document or
    chunk and ids as text; rows may repeat, which is a finding and not an error.
    """

    def row(name: Column | str, key: Column, detail: Column) -> list[Column]:
        name = F.lit(name) if isinstance(name, str) else name
        return [
            F.col("manifest_id"), name.alias("check_name"), key.cast("string").alias("row_key"),
            detail.cast("string").alias("detail"),
        ]

    asked = queries.groupBy("manifest_id", "query_id").agg(F.count("*").alias("n"))
    # Both sides of every id in one exchange; what is in order leaves no row.
    sides = refs.select(*KEYS, "id", F.lit(True).alias("used"), F.lit(0).alias("n")).unionByName(
        listed.select(*KEYS, "id", F.lit(False).alias("used"), F.lit(1).alias("n"))
    ).groupBy(*KEYS, "id").agg(F.max("used").alias("used"), F.sum("n").alias("n"))
    is_listed = F.col("n") > 0
    not_positive = is_listed & (F.col("kind") == "document") & F.coalesce(F.expr("try_cast(id AS bigint)") < 1, F.lit(True))
    found = stored(sides.where((F.col("n") > 1) | not_positive | (F.col("used") != is_listed) | F.col("id").isNull()))
    evidence = refs.where("kind = 'chunk'").groupBy("manifest_id", "query_id").agg(F.count("*").alias("n"))
    sizes = (
        asked.select("manifest_id", "query_id").join(evidence, ["manifest_id", "query_id"], "left")
        .join(headers.select("manifest_id", "evidence_top_k"), "manifest_id")
        .where(F.coalesce("n", F.lit(0)) != F.col("evidence_top_k"))
    )
    counted = (
        headers.join(asked.groupBy("manifest_id").agg(F.sum("n").alias("queries")), "manifest_id", "left")
        .join(
            listed.groupBy("manifest_id").agg(
                F.count_if(F.col("kind") == "document").alias("documents"), F.count_if(F.col("kind") == "chunk").alias("chunks"),
            ), "manifest_id", "left",
        )
    )
    pairs = F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(stated).cast("bigint").alias("stated"), F.coalesce(found, F.lit(0)).alias("found"))
        for name, stated, found in (
            ("query_count", "query_count", "queries"), ("document_count", "document_count", "documents"),
            ("chunk_count", "chunk_count", "chunks"),
        )
    ])
    totals = counted.select("manifest_id", F.explode(pairs).alias("t")).where(~F.col("t.stated").eqNullSafe(F.col("t.found")))
    # An id without a value equals none; it counts where the sets differ otherwise.
    differs = F.col("used") != is_listed
    open_sets = found.where(differs).select(*KEYS).distinct()
    astray = found.where(differs | F.col("id").isNull()).join(open_sets, KEYS, "left_semi")
    return all_of(
        asked.where("n > 1").select(*row("duplicate_query", F.col("query_id"), F.col("n"))),
        totals.select(*row(F.col("t.name"), F.col("manifest_id"), F.concat_ws(" found ", F.col("t.stated"), F.col("t.found")))),
        found.where("n > 1").select(*row(F.concat(F.lit("duplicate_"), "kind"), F.col("id"), F.col("n"))),
        found.where(not_positive).select(*row("document_not_positive", F.col("id"), F.lit(""))),
        sizes.select(*row("evidence_size", F.col("query_id"), F.coalesce("n", F.lit(0)))),
        astray.where(F.col("used") & (~is_listed | F.col("id").isNull())).select(*row(F.concat(F.lit("unknown_"), "kind"), F.col("id"), F.lit(""))),
        astray.where(is_listed & (~F.col("used") | F.col("id").isNull())).select(*row(F.concat(F.lit("unused_"), "kind"), F.col("id"), F.lit(""))),
    )
