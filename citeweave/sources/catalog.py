"""Citation catalog payloads and the merged corpus manifest."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_LINKS = "STRUCT<pdf: STRING, original: STRING, fulltext: STRING>"
_DOWNLOAD = f"STRUCT<name: STRING, mimetype: STRING, links: {_LINKS}>"
RECORD = (
    "id BIGINT, title STRING, abstract STRING, keywords ARRAY<STRING>, subjectCategories ARRAY<STRING>, "
    "stiType STRING, distribution STRING, disseminated STRING, downloadsAvailable BOOLEAN, "
    f"downloads ARRAY<{_DOWNLOAD}>"
)


def payload_records(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Explode page payloads: a bare list or the list under results/items/citations."""
    wrapped = F.from_json(
        column,
        f"results ARRAY<STRUCT<{_struct(RECORD)}>>, items ARRAY<STRUCT<{_struct(RECORD)}>>, "
        f"citations ARRAY<STRUCT<{_struct(RECORD)}>>",
    )
    bare = F.from_json(F.when(F.ltrim(column).startswith("["), F.col(column)), f"ARRAY<STRUCT<{_struct(RECORD)}>>")
    kept = [c for c in payloads.columns if c != column]
    return payloads.select(
        *kept,
        F.explode(F.coalesce(bare, wrapped["results"], wrapped["items"], wrapped["citations"])).alias("r"),
    ).select(*kept, "r.*")


def _struct(ddl: str) -> str:
    """Field list in struct syntax for a flat column list."""
    depth, parts, current = 0, [], ""
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += char
    parts.append(current.strip())
    return ", ".join(p.replace(" ", ": ", 1) for p in parts)


def payload_total(payload: Column) -> Column:
    """``stats.total`` as a whole number; booleans and texts give null."""
    raw = F.get_json_object(payload, "$.stats.total")
    return F.when(raw.rlike("^-?[0-9]+$"), raw.cast("bigint"))


def absolute_url(base: str, link: Column) -> Column:
    return F.when(link.rlike("^[a-z]+://"), link).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(link, "^/", ""))
    )


def pdf_url(base: str, downloads: Column) -> Column:
    """First download with a pdf link, or whose original file is a pdf."""
    def link(d: Column) -> Column:
        is_pdf = (d["mimetype"] == "application/pdf") | F.lower(d["name"]).endswith(".pdf")
        return F.coalesce(
            F.nullif(d["links"]["pdf"], F.lit("")),
            F.when(F.coalesce(is_pdf, F.lit(False)), F.nullif(d["links"]["original"], F.lit(""))),
        )

    found = F.filter(F.transform(downloads, link), lambda l: l.isNotNull())
    return absolute_url(base, F.try_element_at(found, F.lit(1)))


def fulltext_url(base: str, downloads: Column) -> Column:
    links = F.filter(F.transform(downloads, lambda d: d["links"]["fulltext"]), lambda l: l.isNotNull() & (l != ""))
    return absolute_url(base, F.try_element_at(links, F.lit(1)))


def manifest_entries(records: DataFrame, base: str = "https://catalog.example.org") -> DataFrame:
    """Catalog records to manifest columns; needs ``source_query`` and ``scan_no``."""
    return records.select(
        F.col("id").alias("document_id"), "title", F.nullif(F.col("abstract"), F.lit("")).alias("abstract"),
        F.concat(F.lit(f"{base}/citations/"), F.col("id")).alias("citation_url"),
        pdf_url(base, F.col("downloads")).alias("pdf_url"),
        fulltext_url(base, F.col("downloads")).alias("fulltext_url"),
        "keywords", F.col("subjectCategories").alias("subject_categories"), F.col("stiType").alias("sti_type"),
        "source_query", "scan_no",
    )


def merge_manifest(entries: DataFrame, texts: list[str], sets: list[str]) -> DataFrame:
    """One row per document over all catalog scans.

    ``texts``: first non-null value in scan order. ``sets``: sorted distinct
    union of arrays. Scalars combine map-side with ``min_by``; array members are
    deduplicated as rows first, so a document found by every scan does not
    concentrate its repeats in one task.
    """
    scalars = entries.groupBy("document_id").agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("scan_no"))).alias(c) for c in texts]
    )
    merged = scalars
    for column in sets:
        distinct = entries.select("document_id", F.explode(column).alias("x")).where("x IS NOT NULL").distinct()
        lists = distinct.groupBy("document_id").agg(F.array_sort(F.collect_list("x")).alias(column))
        merged = merged.join(lists, "document_id", "left").withColumn(
            column, F.coalesce(column, F.array().cast("array<string>"))
        )
    return merged


class CatalogPage(InputPartition):
    def __init__(self, offset: int, size: int) -> None:
        self.offset = offset
        self.size = size


class CatalogReader(DataSourceReader):
    """Offset-paged scan: one input partition per page, fetched on executors."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.limit = int(options.get("limit", "100"))
        self.page_size = min(int(options.get("pageSize", "50")), 100)
        if self.limit < 1 or self.page_size < 1:
            raise ValueError("limit and pageSize must be at least 1")
        if not (options.get("q", "").strip() or options.get("title", "").strip()):
            raise ValueError("a catalog scan needs q or title")

    def partitions(self) -> list[InputPartition]:
        return [
            CatalogPage(offset, min(self.page_size, self.limit - offset))
            for offset in range(0, self.limit, self.page_size)
        ]

    def read(self, partition: CatalogPage) -> Iterator[tuple[str, int]]:
        from urllib.parse import urlencode
        from urllib.request import urlopen

        asked = {k: self.options[k] for k in ("q", "title") if self.options.get(k)}
        asked |= {"page.size": partition.size, "page.from": partition.offset, "sort.field": "id", "sort.order": "asc"}
        with urlopen(f"{self.options['url'].rstrip('/')}?{urlencode(asked)}", timeout=30) as reply:
            yield reply.read().decode("utf-8"), partition.offset


class CatalogSource(DataSource):
    """``spark.read.format("citation_catalog").option("url", ...).option("q", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "citation_catalog"

    def schema(self) -> str:
        return "payload STRING, scan_no BIGINT"

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(self.options)
