"""Pages to overlapping word windows with page provenance.

Two forms give the same chunks:

* ``chunk_nested`` - a row already holds all pages of a document: map only, no
  shuffle, no UDF.
* ``chunk_pages`` - one row per page. Word offsets come from two-level running
  totals and windows are assembled from page slices, so neither a task nor an
  array ever holds a whole document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.scale import running_totals


@dataclass(frozen=True)
class ChunkSettings:
    chunk_words: int = 300
    overlap_words: int = 60

    def __post_init__(self) -> None:
        if self.chunk_words < 1 or not 0 <= self.overlap_words < self.chunk_words:
            raise ValueError("overlap_words must be smaller than chunk_words")

    @property
    def stride(self) -> int:
        return self.chunk_words - self.overlap_words


PAGES_PER_BLOCK = 512


def page_records(documents: DataFrame) -> DataFrame:
    """Derive page rows from a text table: every line is one page."""
    lines = F.posexplode(F.split("text", "\n"))
    return (
        documents.select(
            "doc_id", "source", F.sha2("text", 256).alias("document_sha256"), lines.alias("pos", "raw")
        )
        .withColumn("text", T.normalize_page_text(F.col("raw")))
        .select(
            F.concat_ws(":", F.col("doc_id"), F.lit("page"), F.col("pos") + 1).alias("page_id"),
            F.col("doc_id").alias("document_id"),
            (F.col("pos") + 1).cast("bigint").alias("page_number"),
            "text",
            F.length("text").cast("bigint").alias("character_count"),
            F.when(F.col("text") != "", F.lit("ok")).otherwise(F.lit("empty")).alias("extraction_status"),
            F.col("source").alias("source_url"),
            F.concat(F.lit("doc/"), F.col("doc_id")).alias("citation_url"),
            "document_sha256",
        )
    )


def window_count(n: Column, settings: ChunkSettings) -> Column:
    """Number of windows for ``n`` words; the last one is flush with the end."""
    extra = F.ceil((n - settings.chunk_words) / F.lit(settings.stride))
    return F.when(n > 0, F.greatest(F.lit(0), extra) + 1).otherwise(F.lit(0)).cast("bigint")


def _finish(chunks: DataFrame, settings: ChunkSettings) -> DataFrame:
    return chunks.select(
        F.format_string("%d:chunk:%05d", "document_id", "chunk_index").alias("chunk_id"),
        "document_id", "chunk_index", "page_start", "page_end", "page_ids", "text", "word_count",
        F.length("text").cast("bigint").alias("character_count"),
        F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("bigint").alias("token_estimate"),
        "citation_url", "source_url", "document_sha256",
    )


def chunk_nested(documents: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Chunk rows that carry their whole text; pages are the lines of the text."""
    size, stride = settings.chunk_words, settings.stride
    pages = F.filter(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.struct((i + 1).cast("bigint").alias("page"), T.words(line).alias("words")),
        ),
        lambda p: F.size(p["words"]) > 0,
    )
    staged = documents.select(
        F.col("doc_id").alias("document_id"), "source", "text", pages.alias("pages")
    ).withColumn("words", F.flatten("pages.words"))  # a line break is a blank
    staged = staged.withColumn("n", F.size("words").cast("bigint")).withColumn(
        "ends", _running_ends(F.col("pages"))
    )
    # The outer form keeps the size test above the explode instead of splitting
    # every text a second time in an inferred filter below it.
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), window_count(F.col("n"), settings) - 1))
    exploded = staged.select(
        "document_id", "source", "pages", "ends", "words", "n",
        F.sha2("text", 256).alias("document_sha256"), F.explode_outer(numbers).alias("chunk_index"),
    ).where(F.col("chunk_index").isNotNull())
    start = F.col("chunk_index") * stride
    end = F.least(start + size, F.col("n"))
    first_page = F.size(F.filter("ends", lambda e: e <= start))
    last_page = F.size(F.filter("ends", lambda e: e < end))
    covered = F.slice("pages.page", (first_page + 1).cast("int"), (last_page - first_page + 1).cast("int"))
    chunks = exploded.select(
        "document_id", "chunk_index", "source", "document_sha256",
        F.slice("words", (start + 1).cast("int"), F.lit(size)).alias("window"),
        covered.alias("covered"),
    ).select(
        "document_id", "chunk_index",
        F.element_at("covered", 1).alias("page_start"),
        F.element_at("covered", -1).alias("page_end"),
        F.transform("covered", lambda p: F.concat_ws(":", F.col("document_id"), F.lit("page"), p)).alias("page_ids"),
        F.array_join("window", " ").alias("text"),
        F.size("window").cast("bigint").alias("word_count"),
        F.concat(F.lit("doc/"), F.col("document_id")).alias("citation_url"),
        F.col("source").alias("source_url"), "document_sha256",
    )
    return _finish(chunks, settings)


def _running_ends(pages: Column) -> Column:
    """Running word count after each page of a nested page array."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(
        pages,
        start,
        lambda acc, p: F.struct(
            (acc["total"] + F.size(p["words"])).alias("total"),
            F.concat(acc["ends"], F.array(acc["total"] + F.size(p["words"]))).alias("ends"),
        ),
        lambda acc: acc["ends"],
    )


def chunk_pages(pages: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Chunk page rows; safe when one document holds a large share of all pages."""
    size, stride = settings.chunk_words, settings.stride
    usable = (
        pages.where("extraction_status = 'ok'")
        .where(T.strip(F.col("text")) != "")
        .withColumn("words", T.words(F.col("text")))
        .withColumn("block", F.floor(F.col("page_number") / PAGES_PER_BLOCK))
        .withColumn("n_words", F.size("words").cast("bigint"))
        .drop("text", "character_count")
    )
    placed = running_totals(
        usable, ["document_id"], "block", [F.col("page_number")], {"end_word": F.col("n_words")}, {"end_word": "n"}
    )
    first_word = F.col("end_word") - F.col("n_words")
    last_window = window_count(F.col("n"), settings) - 1
    # Windows touching words [first_word, end_word): from the first whose end is
    # beyond first_word to the last whose start is before end_word.
    from_window = F.greatest(F.lit(0), F.floor((first_word - size) / F.lit(stride)) + 1)
    to_window = F.least(last_window, F.floor((F.col("end_word") - 1) / F.lit(stride)))
    pieces = placed.withColumn(
        "chunk_index", F.explode(F.sequence(from_window.cast("bigint"), to_window.cast("bigint")))
    )
    window_start = F.col("chunk_index") * stride
    cut_from = F.greatest(window_start - first_word, F.lit(0))
    cut_to = F.least(window_start + size - first_word, F.col("n_words"))
    pieces = pieces.select(
        "document_id", "chunk_index", "page_number", "page_id", "citation_url", "source_url", "document_sha256",
        F.slice("words", (cut_from + 1).cast("int"), (cut_to - cut_from).cast("int")).alias("part"),
    )
    # A window holds at most ``chunk_words`` non-empty parts, so this group is bounded.
    grouped = pieces.groupBy("document_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "page_id", "part"))).alias("parts"),
        F.min_by("citation_url", "page_number").alias("citation_url"),
        F.min_by("source_url", "page_number").alias("source_url"),
        F.min_by("document_sha256", "page_number").alias("document_sha256"),
    )
    chunks = grouped.withColumn("window", F.flatten("parts.part")).select(
        "document_id", "chunk_index",
        F.element_at("parts.page_number", 1).alias("page_start"),
        F.element_at("parts.page_number", -1).alias("page_end"),
        F.array_distinct("parts.page_id").alias("page_ids"),
        F.array_join("window", " ").alias("text"),
        F.size("window").cast("bigint").alias("word_count"),
        "citation_url", "source_url", "document_sha256",
    )
    return _finish(chunks, settings)


def chunk_receipts(pages: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Per-document counts, including documents that yield no chunk."""
    usable = (F.col("extraction_status") == "ok") & (T.strip(F.col("text")) != "")
    counted = pages.select(
        "document_id",
        F.when(usable, 1).otherwise(0).alias("usable"),
        F.when(usable, F.size(T.words(F.col("text")))).otherwise(0).alias("n_words"),
    )
    totals = counted.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.sum("usable").cast("bigint").alias("nonempty_page_count"),
        F.sum("n_words").cast("bigint").alias("total_words"),
    )
    return totals.withColumn("chunk_count", window_count(F.col("total_words"), settings))


def inconsistent_provenance(pages: DataFrame) -> DataFrame:
    """Documents whose pages disagree on checksum, citation or source."""
    varying = [
        F.when(F.min(c) != F.max(c), F.lit(c)).alias(c)
        for c in ("document_sha256", "citation_url", "source_url")
    ]
    checked = pages.where("extraction_status = 'ok'").groupBy("document_id").agg(*varying)
    return checked.select(
        "document_id",
        F.array_compact(F.array("document_sha256", "citation_url", "source_url")).alias("fields"),
    ).where(F.size("fields") > 0)
