import hashlib
import json
import random
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citeweave import schemas
from citeweave.operators import lexical, service_metrics
from citeweave.sources import catalog, files, index_store, records
from citeweave.streaming import rate_limit, telemetry


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("b", "two"), ("a", None)], schemas.QUERY)
    path = str(tmp_path / "q")
    records.write_records(rows, path, ["query_id"])
    text = [r.value for r in spark.read.text(path).collect()]
    assert sorted(text) == ['{"query":"two","query_id":"b"}', '{"query":null,"query_id":"a"}']
    assert records.read_records(spark, path, schemas.QUERY).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"query_id": "a", "query": "x", "more": 1}\n\n{broken\n')
    loose = records.read_records(spark, str(bad), schemas.QUERY, strict=False).cache()
    assert [r[0] for r in records.rejected_rows(loose).collect()] == ["{broken"]
    with pytest.raises(Exception):
        records.read_records(spark, str(bad), schemas.QUERY).collect()
    good = tmp_path / "good.jsonl"
    good.write_text('{"query_id": "a", "query": "x", "more": 1}\n')
    assert records.unknown_fields(spark, str(good), schemas.QUERY).first().field == "more"
    with pytest.raises(ValueError):
        records.require_unique(rows.union(rows), ["query_id"])
    with pytest.raises(ValueError):
        records.require_rows(rows.where("false"))
    with pytest.raises(ValueError):
        records.read_batches(spark, path, schemas.QUERY, 99)


def test_checkpoints_are_append_only(spark, tmp_path):
    path = str(tmp_path / "cp")
    first = spark.createDataFrame([("t", 1, "s1")], schemas.CHECKPOINT)
    records.append_checkpoint(first, path)
    records.append_checkpoint(spark.createDataFrame([("t", 2, "s2")], schemas.CHECKPOINT), path)
    with pytest.raises(FileExistsError):
        records.append_checkpoint(first, path)
    assert spark.read.parquet(path).count() == 2


def test_catalog_payloads_and_paging(spark):
    record = {"id": 7, "title": "T", "downloads": [{"name": "a.txt", "links": {"original": "/a"}}, {"name": "b.PDF", "mimetype": "x", "links": {"original": "/b", "fulltext": "/f"}}]}
    rows = [(1, json.dumps({"items": [record], "stats": {"total": 5}})), (2, json.dumps([record, record])), (3, json.dumps({"results": [], "stats": {"total": True}}))]
    pages = spark.createDataFrame(rows, "scan_no int, payload string")
    got = catalog.payload_records(pages).select("scan_no", catalog.pdf_url("http://h", F.col("downloads")).alias("p"), catalog.fulltext_url("http://h", F.col("downloads")).alias("f")).collect()
    assert sorted(r.scan_no for r in got) == [1, 2, 2] and {(r.p, r.f) for r in got} == {("http://h/b", "http://h/f")}
    assert [r[0] for r in pages.orderBy("scan_no").select(catalog.payload_total(F.col("payload"))).collect()] == [5, None, None]
    reader = catalog.CatalogReader({"q": "ducts", "limit": "120", "pageSize": "50", "url": "http://h"})
    assert [(p.offset, p.size) for p in reader.partitions()] == [(0, 50), (50, 50), (100, 20)]
    with pytest.raises(ValueError):
        catalog.CatalogReader({"q": "  "})


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Store:
    """Shared storage stand-in: a folder."""

    def __init__(self, root):
        self.root = root

    def path(self, key):
        return f"{self.root}/{key}.pdf"

    def exists(self, key):
        import os

        return os.path.exists(self.path(key))

    def read(self, key):
        return open(self.path(key), "rb").read()

    def write(self, key, content):
        with open(self.path(key), "wb") as handle:
            handle.write(content)
        return self.path(key)


def fetch(url):
    if url.endswith("missing"):
        raise OSError("not found")
    return b"%PDF-1 " + url.encode() if url.startswith("pdf") else b"<html>"


def split_pages(content):
    return ["first \r\n page", ""]


def test_download_and_extract(spark, tmp_path):
    entries = spark.createDataFrame([(1, "pdf/a"), (2, "web"), (3, "pdf/missing"), (4, None)], "document_id bigint, pdf_url string")
    store = Store(str(tmp_path))
    got = {r.document_id: r for r in files.download(entries, False, fetch, store).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "downloaded", 2: "failed", 3: "failed"}
    assert got[3].error == "not found"
    again = files.download(entries, False, fetch, store)
    receipts = spark.createDataFrame(again.collect(), again.schema)
    assert receipts.where("document_id = 1").first().status == "skipped"
    content = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_replace("path", "^file:", "").alias("path"), "content")
    read = files.read_pages(files.extractable(receipts, 10_000), content, split_pages)
    pages = files.extract_pages(read)
    assert [(r.page_id, r.text, r.extraction_status) for r in pages.orderBy("page_number").collect()] == [
        ("1:page:1", "first\npage", "ok"), ("1:page:2", "", "empty"),
    ]
    done = files.extraction_receipts(read).first()
    assert (done.page_count, done.nonempty_page_count, done.status, done.error) == (2, 1, "processed", None)
    facts = files.file_facts(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    assert facts.first().is_pdf
    pins = spark.createDataFrame([(store.path(1), "0"), ("nowhere", None)], "path string, expected_sha256 string")
    assert {r.status for r in files.readiness(facts, pins).collect()} == {"checksum_mismatch", "missing"}


def test_bad_files_are_receipts(spark):
    sound = hashlib.sha256(b"%PDF-1").hexdigest()
    receipts = spark.createDataFrame(
        [(1, "a", sound), (2, "b", "0"), (3, "c", sound), (4, "d", sound), (5, "e", hashlib.sha256(b"none").hexdigest())],
        "document_id bigint, local_path string, sha256 string",
    ).withColumn("source_url", F.lit("u"))
    content = spark.createDataFrame(
        [("a", b"%PDF-1"), ("b", b"%PDF-1"), ("d", b"%PDF-1"), ("e", b"none")], "path string, content binary"
    ).withColumn("content", F.when(F.col("path") == "d", F.encode(F.lit("torn"), "UTF-8")).otherwise(F.col("content")))
    torn = receipts.withColumn(
        "sha256", F.when(F.col("document_id") == 4, hashlib.sha256(b"torn").hexdigest()).otherwise(F.col("sha256"))
    )

    def split(data):
        if data == b"torn":
            raise ValueError("no trailer")
        return [] if data == b"none" else ["x"]

    read = files.read_pages(torn, content, split)
    got = {r.document_id: (r.page_count, r.status, r.error) for r in files.extraction_receipts(read).collect()}
    assert got == {
        1: (1, "processed", None), 2: (0, "failed", "Checksum mismatch"), 3: (0, "failed", "File is missing"),
        4: (0, "failed", "Unreadable: no trailer"), 5: (0, "processed", None),
    }
    assert [r.page_id for r in files.extract_pages(read).collect()] == ["1:page:1"]


def test_latest_wins(spark):
    schema = "k string, version int, v string"
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 5, "keep")], schema)
    incoming = spark.createDataFrame([("a", 1, "tie"), ("b", 4, "late"), ("c", 1, "new"), ("c", 2, "newer")], schema)
    got = {r.k: r.v for r in index_store.latest_wins(stored, incoming, "k", "version").collect()}
    assert got == {"a": "tie", "b": "keep", "c": "newer"}


def test_stored_indexes(spark, tmp_path):
    chunks = spark.range(50).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("alpha t"), "id").alias("text"))
    index_store.save_lexical(lexical.build_index(chunks), "lex_index", 4)
    stored = index_store.load_lexical(spark, "lex_index")
    asked = spark.createDataFrame([("q", "t7 alpha")], "query_id string, query string")
    hits = lexical.search(stored, asked, 3)
    assert hits.where("rank = 1").first().chunk_id == "c7"
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<float>")
    index_store.save_vectors(vectors, str(tmp_path / "v"), "m")
    assert index_store.load_vectors(spark, str(tmp_path / "v"), "m").count() == 2
    with pytest.raises(ValueError):
        index_store.load_vectors(spark, str(tmp_path / "v"), "other")


def plain_limiter(rows, limit, window):
    logs, out = {}, {}
    for request_id, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        log = [t for t in logs.get(key, []) if t > at - timedelta(seconds=window)]
        out[request_id] = len(log) < limit
        if len(log) < limit:
            log.append(at)
        logs[key] = log
    return out


def requests(seed=1, n=300):
    rng = random.Random(seed)
    at, rows = datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 5, 10, 10, 90]))
        rows.append((i, rng.choice(["hot", "hot", "b"]), at))
    return rows


@pytest.mark.parametrize("limit, window", [(1, 10), (3, 60)])
def test_limiter_against_a_loop(spark, limit, window):
    rows = requests()
    df = spark.createDataFrame(rows, "request_id bigint, key string, ts timestamp").repartition(6)
    got = {r.request_id: r.allowed for r in rate_limit.limit_requests(df, limit, window).collect()}
    assert got == plain_limiter(rows, limit, window)


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = requests(2, 120)
    schema = "request_id bigint, key string, ts timestamp"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    decided = rate_limit.limit_stream(stream, 3, 60)
    query = decided.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {r.request_id: r.allowed for r in spark.table("limited").collect()}
    assert got == plain_limiter(rows, 3, 60)


def test_windowed_stream(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string, seconds double"
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts, 'a' kind, 0.2D seconds union all select timestamp_ntz'2024-01-01 05:10:00', 'a', 9D").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    counted = telemetry.windowed_counters(stream, "ts", ["kind"], "seconds")
    query = counted.writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    rows = spark.table("windowed").collect()
    assert len(rows) == 1 and rows[0].requests_total == 1
    assert rows[0][f"le_{service_metrics.DURATION_BUCKETS.index(0.25)}"] == 1
    batch = telemetry.windowed_counters(spark.read.schema(schema).parquet(str(tmp_path / "in")), "ts", ["kind"], "seconds")
    assert batch.count() == 2
