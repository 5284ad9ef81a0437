import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions import vectors as V
from citeweave.operators import chunking, dense, facets, fusion, lexical, ranking_metrics
from citeweave.plans import tables as P


def plain_chunks(words, size=300, overlap=60):
    out, start = [], 0
    while start < len(words):
        end = min(start + size, len(words))
        out.append(" ".join(words[start:end]))
        if end == len(words):
            break
        start = end - overlap
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_chunk_forms_agree_with_a_loop(spark, partitions):
    rng = random.Random(3)
    docs = []
    for doc_id, n in enumerate([0, 1, 299, 300, 301, 540, 541, 2000]):
        words = [f"w{rng.randrange(50)}" for _ in range(n)]
        text = ""
        for i, w in enumerate(words):
            text += w + (rng.choice(["\n", "\n\n"]) if rng.random() < 0.1 else " ")
        docs.append((doc_id, text, f"s{doc_id}"))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(partitions)
    nested = chunking.chunk_nested(rows)
    paged = chunking.chunk_pages(chunking.page_records(rows))
    assert nested.exceptAll(paged).count() == 0 and paged.exceptAll(nested).count() == 0
    got = {(r.document_id, r.chunk_index): r.text for r in nested.collect()}
    want = {(d, i): c for d, t, _ in docs for i, c in enumerate(plain_chunks(t.split()))}
    assert got == want
    receipts = {r.document_id: r.chunk_count for r in chunking.chunk_receipts(chunking.page_records(rows)).collect()}
    assert receipts == {d: len(plain_chunks(t.split())) for d, t, _ in docs}


def test_one_document_with_most_pages(spark):
    """More pages than one block: offsets must carry across blocks."""
    pages = spark.range(1, 1300).select(
        F.concat(F.lit("1:page:"), "id").alias("page_id"), F.lit(1).cast("bigint").alias("document_id"),
        F.col("id").alias("page_number"), F.concat(F.lit("a"), "id", F.lit(" b")).alias("text"),
        F.lit(3).cast("bigint").alias("character_count"), F.lit("ok").alias("extraction_status"),
        F.lit("s").alias("source_url"), F.lit("c").alias("citation_url"), F.lit("h").alias("document_sha256"),
    )
    words = [w for i in range(1, 1300) for w in (f"a{i}", "b")]
    got = [r.text for r in chunking.chunk_pages(pages).orderBy("chunk_index").collect()]
    assert got == plain_chunks(words)


def plain_bm25(chunks, query, k):
    tok = {c: re.findall(T.LEXICAL_TOKEN, t.lower()) for c, t in chunks}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    scores = {}
    for term in dict.fromkeys(re.findall(T.LEXICAL_TOKEN, query.lower())):
        hits = {c: ts.count(term) for c, ts in tok.items() if term in ts}
        for c, tf in hits.items():
            idf = math.log(1 + (n - len(hits) + 0.5) / (len(hits) + 0.5))
            scores[c] = scores.get(c, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tok[c]) / avg))
    ranked = sorted(((round(s, 8), c) for c, s in scores.items()), key=lambda x: (-x[0], x[1]))
    return [(c, s) for s, c in ranked[:k]]


@pytest.mark.parametrize("bound", [10_000, 0])
def test_bm25_against_a_loop(spark, bound):
    rng = random.Random(5)
    vocabulary = ["the"] * 20 + [f"t{i}" for i in range(30)]
    chunks = [(f"c{i:02d}", " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25)))) for i in range(40)]
    chunks += [("dup1", chunks[3][1]), ("dup2", chunks[3][1])]
    queries = [("q1", "the t1 t2 t1"), ("q2", "t5, T7!"), ("q3", "absent"), ("q4", "  ")]
    index = lexical.build_index(spark.createDataFrame(chunks, "chunk_id string, text string"))
    asked = spark.createDataFrame(queries, "query_id string, query string")
    got = lexical.search(index, asked, 7, max_query_terms=bound, salts=5).collect()
    for query_id, query in queries:
        mine = [(r.chunk_id, r.score) for r in sorted((r for r in got if r.query_id == query_id), key=lambda r: r.rank)]
        want = plain_bm25(chunks, query, 7)
        assert [c for c, _ in mine] == [c for c, _ in want]
        assert [s for _, s in mine] == pytest.approx([s for _, s in want], abs=2e-8)
    with pytest.raises(ValueError):
        lexical.search(index, asked, 0)


@pytest.mark.parametrize("bound", [100_000, 600])
def test_bm25_of_many_questions_without_a_row_per_question_and_chunk(spark, bound, monkeypatch):
    def joined(*_):
        raise AssertionError("a row per question and chunk")

    monkeypatch.setattr(lexical, "score", joined)
    rng = random.Random(6)
    vocabulary = ["the"] * 10 + [f"t{i}" for i in range(40)]
    chunks = [(f"c{i:02d}", " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25)))) for i in range(50)]
    queries = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 6)))) for i in range(1_100)]
    index = lexical.build_index(spark.createDataFrame(chunks, "chunk_id string, text string"))
    asked = spark.createDataFrame(queries, "query_id bigint, query string")
    got = {}
    for r in lexical.search(index, asked, 4, max_query_terms=bound).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    for query_id, query in queries:
        mine, want = sorted(got.get(query_id, [])), plain_bm25(chunks, query, 4)
        assert [c for _, c, _ in mine] == [c for c, _ in want]
        assert [s for _, _, s in mine] == pytest.approx([s for _, s in want], abs=2e-8)


def test_bm25_scores_without_shuffling_the_postings(spark):
    chunks = spark.range(500).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("a b c"), "id").alias("text"))
    asked = spark.createDataFrame([("q", "a b")], "query_id string, query string")
    index = lexical.build_index(chunks)
    found = lexical.search(index, asked, 3)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == ["c0", "c1", "c10"]
    # Both words are in every chunk, yet a task hands on at most k rows per question.
    weights = pd.DataFrame({"query_id": ["q", "q"], "term": ["a", "b"], "idf": [0.5, 0.4]})
    weights.attrs["query_id"] = "string"
    assert lexical.partial_top(index, weights, 3.0, 3).count() <= 3 * index.tokens.rdd.getNumPartitions()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(query_id#0, chunk_id" not in plan
    assert not re.search(r"hashpartitioning\(query_id#\d+, chunk_id", plan)


def test_dense_paths_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, size=(60, 4)).astype(float)
    vectors[np.abs(vectors).sum(axis=1) == 0] = 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>").repartition(5)
    asked = spark.createDataFrame(rows, "query_id bigint, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(np.clip(unit @ unit.T, -1, 1), 8)
    want = {
        (q, int(c), r + 1) for q in range(60) for r, c in enumerate(np.lexsort((np.arange(60), -scores[q]))[:6])
    }
    for options in ({}, {"max_broadcast_queries": 0, "cell_rows": 17}):
        got = {(r.query_id, r.chunk_id, r.rank) for r in dense.search(corpus, asked, 6, **options).collect()}
        assert got == want


def test_dense_blocks_follow_the_values_and_not_the_tile(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-1, 2, size=(300, 3)).astype(float)
    vectors[np.abs(vectors).sum(axis=1) == 0] = 1.0
    # Many equal scores, every id twice.
    rows = [(i // 2, v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>").repartition(3)
    asked = spark.createDataFrame(rows[::2], "query_id bigint, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(np.clip(unit[::2] @ unit.T, -1, 1), 8)
    ids = np.arange(300) // 2
    want = set()
    for q in range(150):
        other = np.flatnonzero(ids != q)
        order = other[np.lexsort((ids[other], -scores[q][other]))[:7]]
        want |= {(q, int(ids[c]), float(scores[q][c]), r + 1) for r, c in enumerate(order)}
    for options in ({"cell_rows": 16}, {"max_broadcast_queries": 0, "cell_rows": 4}):
        got = {tuple(r) for r in dense.search(corpus, asked, 7, exclude_self=True, **options).select("query_id", "chunk_id", "score", "rank").collect()}
        assert got == want
    # One block holds the whole corpus: k rows per query, whatever the tile.
    assert dense._grid_partials(corpus, asked, 7, True, 4).count() == 150 * 7


def test_vectors_that_are_not_numbers_are_near_nothing(spark):
    corpus = spark.createDataFrame([(i, [float("nan") if i == 2 else 1.0, float(i)]) for i in range(5)], "chunk_id bigint, vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, vector array<double>")
    for bound in (10, 0):
        got = dense.search(corpus, asked, 3, max_broadcast_queries=bound).orderBy("rank").collect()
        assert [r.chunk_id for r in got] == [0, 1, 3]


def test_passage_windows_are_built_once(spark):
    rows = spark.createDataFrame([("a", "One two, three four five six seven EIGHT nine nine-ten"), ("b", "one two"), ("c", None)], "k string, t string")
    found = P.shingles(rows, "k", F.col("t"))
    words = "one two three four five six seven eight nine nine ten".split()
    want = spark.createDataFrame([(" ".join(words[i : i + 8]),) for i in range(4)], "w string").select(F.xxhash64("w"))
    assert {tuple(r) for r in found.collect()} == {("a", r[0]) for r in want.collect()}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("{7}") == 1


def test_vectors_without_direction_are_rows_of_a_report(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "chunk_id bigint, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id bigint, vector array<double>")
    for bound in (10, 0):
        got = dense.search(corpus, asked, 5, max_broadcast_queries=bound).collect()
        assert [(r.query_id, r.chunk_id, r.score) for r in got] == [(1, 2, 0.6)]
    assert {r.ref for r in dense.undirected(corpus, "chunk_id").collect()} == {"1", "3"}
    with pytest.raises(ValueError, match="zero vector"):
        dense._unit(np.zeros((1, 2)))


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, score double")


def test_rrf_order_and_provenance(spark):
    bm25 = ranked(spark, [("q", "a", 1, 9.0), ("q", "b", 2, 8.0), ("p", "z", 1, 1.0)])
    vec = ranked(spark, [("q", "b", 1, 0.5), ("q", "c", 2, 0.4)])
    got = {(r.query_id, r.rank): r for r in fusion.fuse(bm25, vec, 5).collect()}
    assert [got["q", i].chunk_id for i in (1, 2, 3)] == ["b", "a", "c"]
    assert got["q", 1].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-12)
    assert got["q", 1].retrieved_by == ["bm25", "dense"] and got["p", 1].retrieved_by == ["bm25"]
    louder = bm25.withColumn("score", F.col("score") * 1000)
    order = lambda df: [(r.chunk_id, r.rank) for r in df.orderBy("query_id", "rank").collect()]
    assert order(fusion.fuse(louder, vec, 5)) == order(fusion.fuse(bm25, vec, 5))
    assert fusion.invalid_hits(fusion.fuse(bm25, vec, 5)).count() == 0


def test_rerank_and_model_hook(spark):
    chunks = spark.createDataFrame([("a", "x y"), ("b", "x"), ("c", "q")], "chunk_id string, text string")
    queries = spark.createDataFrame([("q", "x y")], "query_id string, query string")
    hits = fusion.fuse(ranked(spark, [("q", c, i + 1, 1.0) for i, c in enumerate("cba")]), ranked(spark, [("q", "b", 1, 1.0)]), 3)
    assert [r.chunk_id for r in fusion.rerank(hits, queries, chunks, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    by_length = fusion.model_score(lambda query, text: -text.str.len().astype(float))
    first = fusion.rerank(hits, queries, chunks, 1, scorer=by_length).first()
    assert first.chunk_id == "b"


def test_facet_mix_against_a_loop(spark):
    rng = random.Random(2)
    pool = [f"c{i}" for i in range(9)]
    text = {c: ("left " if rng.random() < 0.5 else "") + ("right" if rng.random() < 0.5 else "") for c in pool}
    chunks = spark.createDataFrame(list(text.items()), "chunk_id string, text string")
    searches = facets.plan_searches(
        spark.createDataFrame([("q", "What ducts are shared by left systems and the right?")], "query_id string, query string")
    )
    assert {r.facet_no: r.search_query for r in searches.collect()}[1] == "left systems ducts"
    orders = {n: rng.sample(pool, 7) for n in (0, 1, 2)}
    rows = [(f"q#{n}", c, i + 1, 1.0) for n, cs in orders.items() for i, c in enumerate(cs)]
    hits = spark.createDataFrame(rows, "search_id string, chunk_id string, rank int, score double")
    got = [r.chunk_id for r in facets.mix(hits, searches, chunks, 5).orderBy("rank").collect()]
    buckets = [[c for c in orders[n] if w in text[c].split()] for n, w in ((1, "left"), (2, "right"))]
    want = []
    if all(buckets):
        for position in range(2):
            for bucket in buckets:
                if position < len(bucket) and bucket[position] not in want:
                    want.append(bucket[position])
    want += [c for c in orders[0] if c not in want]
    assert got == want[:5]


def test_ranking_metrics(spark):
    hits = ranked(spark, [("q", c, i + 1, 1.0) for i, c in enumerate(["x", "a", "y", "b"])] + [("r", "x", 1, 1.0)])
    qrels = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "z"), ("r", "n")], "query_id string, chunk_id string")
    got = {r.query_id: r for r in ranking_metrics.per_query(hits, qrels).collect()}
    assert got["q"].recall_at_5 == pytest.approx(2 / 3, abs=1e-6) and got["q"].reciprocal_rank_at_10 == 0.5
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert got["q"].ndcg_at_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal, abs=1e-6)
    assert got["r"].ndcg_at_10 == 0.0 and got["r"].recall_at_10 == 0.0


def test_pool_is_blinded_and_complete(spark):
    import hashlib

    chunks = spark.createDataFrame(
        [(f"c{i}", i, 1, 1, "u", "s", f" text  {i} ") for i in range(6)],
        "chunk_id string, document_id bigint, page_start bigint, page_end bigint, citation_url string, source_url string, text string",
    )
    carried = spark.createDataFrame([("q", "c5"), ("q", "c0")], "query_id string, chunk_id string")
    pool = fusion.candidate_pool(
        ranked(spark, [("q", "c0", 1, 2.0), ("q", "c1", 2, 1.0)]), ranked(spark, [("q", "c2", 1, 0.5)]), carried, chunks
    ).orderBy("candidate_id").collect()
    want = sorted(["c0", "c1", "c2", "c5"], key=lambda c: hashlib.sha256(f"42:q:{c}".encode()).hexdigest())
    assert [r.chunk_id for r in pool] == want and pool[0].candidate_id == "q:c001"
    assert {r.chunk_id: r.retrieved_by for r in pool}["c0"] == ["bm25", "v0.1-qrels"]


def test_an_encoder_gets_few_texts_at_a_time_and_every_one(spark):
    rows = spark.range(1000, numPartitions=1).select(
        "id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("word "), F.col("id").cast("string"))).alias("text")
    )

    def sizes(texts):
        return np.array([[len(texts), -1.0 if t is None else float(t.split()[1])] for t in texts])

    found = rows.select("id", V.encode(F.col("text"), sizes).alias("vector")).collect()
    assert max(r.vector[0] for r in found) <= V.BLOCK_ROWS
    assert [r.vector[1] for r in sorted(found)] == [-1.0 if i % 7 == 0 else float(i) for i in range(1000)]
    plain = rows.select("id", V.encode(F.col("text")).alias("vector")).orderBy("id").toPandas()
    assert (np.array(plain["vector"].tolist()) == V.hashed_counts(rows.orderBy("id").toPandas()["text"])).all()
    assert rows.where("id < 0").select(V.encode(F.col("text")).alias("vector")).collect() == []


def _vectors(spark, name, vectors, ids=None):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<double>").repartition(3)


def test_streamed_queries_in_batches_against_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(90, 6))
    vectors[20:50] = vectors[20]  # copies
    vectors[50:70] = vectors[50] + 1e-7 * rng.normal(size=(20, 6))  # closer than single precision tells
    ids = rng.permutation(90)
    ids[3] = ids[4]  # a query id of two vectors gets one ranking
    corpus, asked = _vectors(spark, "chunk_id", vectors, ids), _vectors(spark, "query_id", vectors, ids)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(np.clip(unit @ unit.T, -1, 1), 8)
    for own in (False, True):
        want = set()
        for q in set(ids.tolist()):
            held = sorted((-scores[at][c], int(ids[c])) for at in np.flatnonzero(ids == q) for c in range(90) if not (own and ids[c] == q))
            want |= {(int(q), c, -s, r + 1) for r, (s, c) in enumerate(held[:5])}
        found = {
            "streamed": dense.streamed(corpus, asked, 5, own, 7, query_values=100), "gridded": dense.gridded(corpus, asked, 5, own, 7),
            "one batch": dense.streamed(corpus, asked, 5, own),
        }
        for name, hits in found.items():
            got = {(r.query_id, r.chunk_id, r.score, r.rank) for r in hits.collect()}
            assert {g[:2] + g[3:] for g in got} == {w[:2] + w[3:] for w in want}, name
            assert np.allclose(sorted(g[2] for g in got), sorted(w[2] for w in want), atol=1.1e-8), name
    assert dense.streamed(corpus, asked.where("query_id < 0"), 5).count() == 0


def test_copies_beyond_the_first_are_not_multiplied():
    unit = dense._unit(np.repeat(np.array([[1.0, 2.0], [2.0, 1.0], [0.0, 1.0]]), [5, 1, 3], axis=0))
    assert np.flatnonzero(dense._needed(unit, 2)).tolist() == [0, 1, 5, 6, 7]


def test_backend_equivalence_compares_two_paths_at_any_size(spark, tmp_path, monkeypatch):
    from citeweave.plans import retrieval

    vectors = np.random.default_rng(5).normal(size=(40, 3)).tolist()
    spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {tuple(r)[1:] for r in retrieval.backend_equivalence(spark, str(tmp_path)).collect()} == {(True, 0.0, 1.0)}
    grid = dense._grid_partials
    monkeypatch.setattr(dense, "fits", lambda *_, **__: False)  # as with a large table
    monkeypatch.setattr(dense, "_grid_partials", lambda *args: grid(*args).withColumn("score", F.round(F.col("score") - 0.5, 8)))
    got = retrieval.backend_equivalence(spark, str(tmp_path)).collect()
    assert len(got) == 40 and {r.max_score_delta for r in got} == {0.5}


@pytest.mark.parametrize("common", [0.0, 0.05, 2.0])
def test_bm25_blocks_by_product_and_one_by_one(common, monkeypatch):
    """(question, chunk) scores of a block are the same, whatever share of the terms is multiplied as a matrix."""
    monkeypatch.setattr(lexical, "COMMON", common)
    monkeypatch.setattr(lexical, "COMMON_TERMS", 11)
    monkeypatch.setattr(lexical, "SPREAD", 50)
    rng = np.random.default_rng(9)
    share = 1 / np.arange(1, 41)
    weight = rng.random((30, 40)) * (rng.random((30, 40)) < share)
    idf = rng.random((40, 20)) * (rng.random((40, 20)) < share[:, None])
    idf[np.arange(40), rng.integers(0, 20, 40)] = 1.0  # every term of a block is asked for
    row, at = np.nonzero(weight)
    place, column = np.nonzero(idf)
    got = lexical._added_up(row, at, weight[row, at], place, column, idf[place, column], (20, 30))
    assert got == pytest.approx((weight @ idf).T)


def test_bm25_leaders_over_blocks_of_chunks():
    rng = np.random.default_rng(10)
    scores = np.round(rng.random((8, 60)) * (rng.random((8, 60)) < 0.2), 1)  # many ties and questions with few chunks
    scores[0] = 0
    ids = np.array([f"c{i:02d}" for i in rng.permutation(60)])
    best = lexical._Leaders(8, 4)
    for start in (0, 3, 20, 40, 59):
        end = {0: 3, 3: 20, 20: 40, 40: 59, 59: 60}[start]
        best.add(ids[start:end], scores[:, start:end])
    got = {(int(q), str(c), float(s)) for q, c, s in zip(best.columns, best.ids, best.scores, strict=True)}
    want = {
        (q, str(ids[c]), float(scores[q, c]))
        for q in range(8) for c in [c for c in np.lexsort((ids, -scores[q])) if scores[q, c] > 0][:4]
    }
    assert got == want
