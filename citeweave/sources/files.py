"""Binary files: checksums, PDF detection, receipts and page extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.schemas import DOWNLOAD_RECEIPT


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, SHA-256 and PDF magic of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
        (F.substring("content", 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")).alias("is_pdf"),
    )


def readiness(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """Required files that are missing, empty or differ from their pinned hash."""
    joined = expected.join(facts, "path", "left")
    return joined.select(
        "path",
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("size_bytes") == 0, "empty")
        .when(F.col("expected_sha256").isNotNull() & (F.col("sha256") != F.col("expected_sha256")), "checksum_mismatch")
        .otherwise("ok").alias("status"),
    )


def download(entries: DataFrame, overwrite: bool, fetch, store) -> DataFrame:
    """Fetch one binary per manifest row on the executors, one receipt per row.

    ``fetch(url) -> bytes`` and ``store.exists/read/write(document_id, ...)`` are
    supplied by the caller (HTTP client and shared storage). Errors become
    receipts; a file that exists is skipped unless ``overwrite``.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for document_id, url in zip(batch["document_id"], batch["pdf_url"]):
                receipt = [document_id, url, None, None, None, "failed", None]
                try:
                    held = store.exists(document_id) and not overwrite
                    content = store.read(document_id) if held else fetch(url)
                    if not content.startswith(b"%PDF-"):
                        raise ValueError("not a PDF file")
                    path = store.path(document_id) if held else store.write(document_id, content)
                    receipt[2:6] = [path, hashlib.sha256(content).hexdigest(), len(content), "skipped" if held else "downloaded"]
                except Exception as error:  # noqa: BLE001 - every failure becomes a receipt
                    receipt[6] = str(error)
                rows.append(receipt)
            yield pd.DataFrame(
                rows, columns=["document_id", "source_url", "local_path", "sha256", "size_bytes", "status", "error"]
            ).astype({"size_bytes": "Int64"})

    wanted = entries.where(F.col("pdf_url").isNotNull()).select("document_id", "pdf_url")
    return wanted.mapInPandas(run, DOWNLOAD_RECEIPT)


def extractable(receipts: DataFrame, max_size_bytes: int | None = None) -> DataFrame:
    """Receipts whose file may be extracted."""
    rows = receipts.where(
        F.col("status").isin("downloaded", "skipped") & F.col("local_path").isNotNull() & F.col("sha256").isNotNull()
    )
    if max_size_bytes is not None:
        rows = rows.where(F.col("size_bytes").isNull() | (F.col("size_bytes") <= max_size_bytes))
    return rows


def read_pages(receipts: DataFrame, facts_with_content: DataFrame, split_pages) -> DataFrame:
    """One row per receipt with ``pages`` and ``error``; no file stops the job.

    ``split_pages(bytes) -> list[str]`` is the PDF library call and the only Python step. Missing files,
    checksum mismatches and files that the library cannot read have no pages and a reason.
    """

    @F.pandas_udf("pages array<string>, error string")
    def pages_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def read(content):
            try:
                return list(split_pages(content)), None
            except Exception as problem:  # whatever the library raises is the row's result
                return None, f"Unreadable: {problem}"

        for batch in batches:
            yield pd.DataFrame([(None, None) if c is None else read(c) for c in batch], columns=["pages", "error"])

    held = facts_with_content.select("path", "content")
    joined = receipts.join(held, receipts.local_path == held.path, "left")
    same = F.sha2("content", 256) == F.col("sha256")
    read = joined.withColumn("read", pages_of(F.when(same, F.col("content"))))
    return read.select(
        "document_id", "source_url", "local_path", "sha256", F.col("read.pages").alias("pages"),
        F.when(F.col("path").isNull(), "File is missing")
        .when(~F.coalesce(same, F.lit(False)), "Checksum mismatch")
        .otherwise(F.col("read.error")).alias("error"),
    )


def extract_pages(read: DataFrame) -> DataFrame:
    """Page rows of the files of ``read_pages``; normalization and status are column expressions."""
    raw = read.select(
        "document_id", "source_url", "local_path", "sha256", F.posexplode("pages").alias("pos", "raw")
    ).withColumn("text", T.normalize_page_text(F.col("raw")))
    return raw.select(
        F.concat_ws(":", F.col("document_id"), F.lit("page"), F.col("pos") + 1).alias("page_id"), "document_id",
        (F.col("pos") + 1).cast("bigint").alias("page_number"), "text",
        F.length("text").cast("bigint").alias("character_count"),
        F.when(F.col("text") != "", "ok").otherwise("empty").alias("extraction_status"),
        F.col("local_path").alias("source_path"), "source_url",
        F.concat(F.lit("doc/"), F.col("document_id")).alias("citation_url"), F.col("sha256").alias("document_sha256"),
    )


def extraction_receipts(read: DataFrame) -> DataFrame:
    """One receipt per file of ``read_pages``; a file without pages is processed, one with an error failed."""
    filled = F.filter("pages", lambda p: T.normalize_page_text(p) != "")
    return read.select(
        "document_id", F.col("local_path").alias("source_path"), F.col("sha256").alias("document_sha256"),
        F.when(F.col("pages").isNull(), 0).otherwise(F.size("pages")).cast("bigint").alias("page_count"),
        F.when(F.col("pages").isNull(), 0).otherwise(F.size(filled)).cast("bigint").alias("nonempty_page_count"),
        F.when(F.col("error").isNotNull(), "failed").otherwise("processed").alias("status"), "error",
    )
