"""Source documents: title families, coverage-driven selection, example plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.scale import global_row_number, running_totals, top_k, with_group_values


def type_rank(kind: Column, priority: list[str]) -> Column:
    """Position in the priority list; unlisted kinds come after all others."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), kind)
    return F.when(order > 0, order - 1).otherwise(len(priority) + 1)


def title_families(documents: DataFrame, priority: list[str]) -> DataFrame:
    """Mark all but the best-ranked document of each normalized title.

    ``documents(document_id, title, chunk_count, kind)``. The representative is
    an aggregate that reaches its rows over salted keys, so a title shared by a
    third of the corpus is no task of its own. A document without a title has
    no family.
    """
    alone = F.concat(F.lit("\u0000"), F.col("document_id").cast("string"))
    keyed = documents.withColumn("normalized_title", F.coalesce(T.normalize_title(F.col("title")), alone)).withColumn(
        "place", F.struct(
            (-F.col("chunk_count")).alias("chunks"), type_rank(F.col("kind"), priority).alias("kind"), F.col("document_id").alias("id")
        )
    )
    families = with_group_values(
        keyed, "normalized_title", ["document_id"], {"family_size": (F.count("*"), F.sum), "best": (F.min("place"), F.min)}
    ).withColumn("representative_id", F.col("best.id"))
    shared = F.col("family_size") > 1
    return families.select(
        *documents.columns,
        F.when(shared, T.title_family(F.col("normalized_title"))).alias("duplicate_family_id"),
        F.when(shared & (F.col("document_id") != F.col("representative_id")), F.col("representative_id")).alias(
            "representative_document_id"
        ),
        (shared & (F.col("document_id") != F.col("representative_id"))).alias("duplicate_excluded"),
    )


@dataclass(frozen=True)
class SelectionSettings:
    target: int
    minimum_chunks: int
    minimums: dict[str, int]
    priority: list[str]


def selection_gaps(selected: DataFrame, documents: DataFrame, settings: SelectionSettings) -> DataFrame:
    """(source_query, minimum, selected): minimums that the selection does not meet, and one row without a
    query if the minimums together exceed the target. No row means that the selection is valid."""
    spark = selected.sparkSession
    wanted = spark.createDataFrame(list(settings.minimums.items()), "source_query string, minimum int")
    held = (
        selected.where("status = 'selected'").select("document_id")
        .join(documents.select("document_id", F.explode(F.array_distinct("source_queries")).alias("source_query")), "document_id")
        .groupBy("source_query").agg(F.count("*").alias("selected"))
    )
    unmet = wanted.join(held, "source_query", "left").select(
        "source_query", "minimum", F.coalesce("selected", F.lit(0)).cast("bigint").alias("selected")
    ).where("selected < minimum")
    total = sum(settings.minimums.values())
    above = [(None, total, settings.target)] if total > settings.target else []
    return unmet.union(spark.createDataFrame(above, "source_query string, minimum int, selected bigint"))


def select_sources(documents: DataFrame, settings: SelectionSettings) -> DataFrame:
    """Fill per-query minimums in order, then the target by rank.

    ``documents`` as for ``title_families`` plus ``source_queries``. Every pick
    lies within the first ``target`` (or minimum) ranked documents of its query or of the
    whole table, so the greedy steps run on that bounded pool while ranking,
    deduplication and the final labels stay distributed over the full table.
    """
    families = title_families(documents, settings.priority)
    eligible = families.where(~F.col("duplicate_excluded") & (F.col("chunk_count") >= settings.minimum_chunks))
    place = [F.desc("chunk_count"), F.asc("kind_rank"), F.asc("document_id")]
    ranked = eligible.withColumn("kind_rank", type_rank(F.col("kind"), settings.priority)).select(
        "document_id", "chunk_count", "kind_rank", "source_queries"
    )
    wanted = list(settings.minimums)
    per_query = top_k(
        ranked.withColumn("q", F.explode(F.array_distinct(F.filter("source_queries", lambda s: s.isin(*wanted))))),
        ["q"], place, max(settings.target, *settings.minimums.values(), 1), "r",
    ).drop("q", "r")
    pool = per_query.unionByName(ranked.orderBy(*place).limit(settings.target)).dropDuplicates(["document_id"])
    # The pool has at most (queries + 1) * max(target, minimums) rows.
    pool = pool.withColumn("reason", F.lit(None).cast("string"))
    for query, minimum in settings.minimums.items():
        member = F.array_contains("source_queries", query)
        group = Window.partitionBy(member)
        have = F.count_if(F.col("reason").isNotNull()).over(group)
        turn = F.row_number().over(group.orderBy(F.col("reason").isNotNull().cast("int"), *place))
        pool = pool.withColumn(
            "reason",
            F.when(
                member & F.col("reason").isNull() & (turn <= F.lit(minimum) - have), F.lit(f"coverage: {query}")
            ).otherwise(F.col("reason")),
        )
    chosen = F.count("reason").over(Window.partitionBy())
    turn = F.row_number().over(Window.partitionBy().orderBy(F.col("reason").isNotNull().cast("int"), *place))
    pool = pool.withColumn(
        "reason",
        F.when(F.col("reason").isNull() & (turn <= F.lit(settings.target) - chosen), F.lit("rank fill")).otherwise(
            F.col("reason")
        ),
    )
    picked = pool.where(F.col("reason").isNotNull()).select("document_id", "reason")
    return families.join(picked, "document_id", "left").select(
        "document_id", "chunk_count", "duplicate_family_id", "representative_document_id",
        F.when(F.col("duplicate_excluded"), "duplicate_excluded")
        .when(F.col("reason").isNotNull(), "selected")
        .otherwise("not_selected").alias("status"),
        F.when(F.col("duplicate_excluded"), "exact-title duplicate")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("chunk_count") < settings.minimum_chunks, "below minimum chunks")
        .otherwise("outside target").alias("reason"),
    )


def source_query_counts(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("source_queries").alias("source_query")).groupBy("source_query").agg(
        F.count("*").alias("document_count")
    )


@dataclass(frozen=True)
class PlanSettings:
    minimum_chunk_words: int = 80
    reference_prefixes: tuple[str, ...] = ("references", "bibliography")
    ordinary_chunks: int = 2
    ordinary_per_document: int = 2
    synthesis_chunks: int = 3
    refusal_chunks: int = 2


def eligible_chunks(chunks: DataFrame, settings: PlanSettings = PlanSettings()) -> DataFrame:
    normalized = T.normalize_training_text(F.col("text"))
    is_reference = F.lit(False)
    for prefix in settings.reference_prefixes:
        is_reference = is_reference | normalized.startswith(" ".join(prefix.lower().split()))
    return chunks.where((F.col("word_count") >= settings.minimum_chunk_words) & ~is_reference)


def window_starts(items: Column, size: int, windows: int) -> Column:
    """Evenly spread window starts; half-even rounding; 0..n-1 on a collision."""
    room = items - size
    if windows == 1:
        return F.array(F.floor(room / 2).cast("int"))
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(windows - 1)),
        lambda i: F.bround(i * room / F.lit(windows - 1)).cast("int"),
    )
    plain = F.sequence(F.lit(0), F.lit(windows - 1))
    return F.when(F.size(F.array_distinct(spread)) == windows, spread).otherwise(plain)


def example_plan(
    chunks: DataFrame, synthesis_documents: DataFrame, refusal_documents: DataFrame,
    settings: PlanSettings = PlanSettings(),
) -> DataFrame:
    """Planned examples with sequential ids in (document, type, start) order.

    Chunks are numbered inside their document and pick the (few) planned windows
    that cover them; ids come from a two-level global numbering.
    """
    usable = eligible_chunks(chunks, settings).select("document_id", "chunk_index", "chunk_id", "word_count")
    numbered = running_totals(
        usable.withColumn("slot", F.floor(F.col("chunk_index") / 4096)), ["document_id"], "slot",
        [F.col("chunk_index"), F.col("chunk_id")], {"ordinal": F.lit(1)}, {"ordinal": "items"},
    ).select(
        "document_id", (F.col("ordinal") - 1).cast("int").alias("position"), F.col("items").cast("int").alias("n"),
        "chunk_id", "word_count",
    )
    flagged = numbered.join(
        synthesis_documents.select("document_id", F.lit(True).alias("synthesis")), "document_id", "left"
    ).join(refusal_documents.select("document_id", F.lit(True).alias("refusal")), "document_id", "left")
    s = settings

    def windows(kind_no: int, kind: str, starts: Column, size: int) -> Column:
        return F.transform(
            starts,
            lambda a: F.struct(
                F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("example_type"), a.alias("start"),
                F.lit(size).alias("size"),
            ),
        )

    none = F.array().cast("array<struct<kind_no:int,example_type:string,start:int,size:int>>")
    n = F.col("n")
    planned = F.concat(
        F.when(
            n - s.ordinary_chunks + 1 >= s.ordinary_per_document,
            windows(0, "ordinary", window_starts(n, s.ordinary_chunks, s.ordinary_per_document), s.ordinary_chunks),
        ).otherwise(none),
        F.when(
            F.col("synthesis") & (n >= s.synthesis_chunks),
            windows(1, "synthesis", F.array(F.floor((n - s.synthesis_chunks) / 2).cast("int")), s.synthesis_chunks),
        ).otherwise(none),
        F.when(
            F.col("refusal") & (n >= s.refusal_chunks),
            windows(2, "refusal", F.array(F.floor(2 * (n - s.refusal_chunks) / 3).cast("int")), s.refusal_chunks),
        ).otherwise(none),
    )
    # The windows follow from the document's chunk count, so every chunk row finds
    # the windows it belongs to by itself.
    mine = F.filter(
        planned, lambda w: (w["start"] <= F.col("position")) & (F.col("position") < w["start"] + w["size"])
    )
    placed = flagged.select(
        "document_id", "position", "chunk_id", "word_count", F.explode_outer(mine).alias("w")
    ).where("w IS NOT NULL").select("document_id", "position", "chunk_id", "word_count", "w.*")
    bundles = placed.groupBy("document_id", "kind_no", "example_type", "start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.sum("word_count").alias("evidence_word_count"),
    )
    order_keys = [F.col("document_id"), F.col("kind_no"), F.col("start")]
    return global_row_number(bundles, F.floor(F.col("document_id") / 1024), order_keys, "plan_no").select(
        F.format_string("plan_%04d", "plan_no").alias("plan_id"), "example_type", "document_id", "chunk_ids",
        "evidence_word_count",
    )
