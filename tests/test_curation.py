import random

import pytest
from pyspark.sql import functions as F

from citeweave.operators import agents, integrity, leakage, pairs, scale, selection, split


def union_find(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e, d in links:
        a, b = find(("e", e)), find(("d", d))
        if a != b:
            parent[a] = b
    groups = {}
    for e, _ in links:
        groups.setdefault(find(("e", e)), set()).add(e)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(8)
    links = {
        "random": [(rng.randrange(80), f"d{rng.randrange(70)}") for _ in range(110)],
        "chain": [(i, f"d{i}") for i in range(40)] + [(i, f"d{i + 1}") for i in range(40)],
        "star": [(i, "hot") for i in range(50)] + [(i, f"own{i}") for i in range(80)],
    }[kind]
    rows = split.example_components(spark.createDataFrame(links, "example_id bigint, document_id string"))
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.component, set()).add(r.example_id)
    assert {frozenset(g) for g in groups.values()} == union_find(links)
    for name, group in groups.items():
        assert int(name[1:]) == min(group)


def test_split_prefix_against_a_loop(spark):
    import hashlib

    sizes = {f"k{i}": 1 + i % 5 for i in range(30)}
    members = [(f"{c}-{j}", c) for c, n in sizes.items() for j in range(n)]
    rows = spark.createDataFrame(members, "example_id string, component string").repartition(3)
    order = sorted(sizes, key=lambda c: (int.from_bytes(hashlib.sha256(f"5:{c}".encode()).digest()[:8], "big") / 2.0**64, c))
    for fraction in (0.1, 0.37):
        target = max(1, min(len(members) - 1, round(len(members) * fraction)))
        best, cumulative = (None, 1), 0
        for prefix in range(1, len(order)):
            cumulative += sizes[order[prefix - 1]]
            if best[0] is None or abs(cumulative - target) < best[0]:
                best = (abs(cumulative - target), prefix)
        dev = {r.component for r in split.split(rows, fraction, 5).where("side = 'dev'").collect()}
        assert dev == set(order[: best[1]])
    assert {r.side for r in split.split(rows, 0.0, 5).collect()} == {"train"}
    single = rows.withColumn("component", F.lit("only"))
    assert {r.side for r in split.split(single, 0.5, 5).collect()} == {"train"}


def plain_selection(docs, settings):
    rank = lambda d: (-d["chunk_count"], settings.priority.index(d["kind"]) if d["kind"] in settings.priority else 99, d["document_id"])
    families = {}
    for d in docs:
        families.setdefault(d["title"].lower(), []).append(d)
    dropped = {d["document_id"] for f in families.values() for d in f if d is not min(f, key=rank)}
    eligible = sorted((d for d in docs if d["document_id"] not in dropped and d["chunk_count"] >= settings.minimum_chunks), key=rank)
    chosen = {}
    for name, minimum in settings.minimums.items():
        while sum(name in d["source_queries"] and d["document_id"] in chosen for d in eligible) < minimum:
            pick = next(d for d in eligible if d["document_id"] not in chosen and name in d["source_queries"])
            chosen[pick["document_id"]] = f"coverage: {name}"
    for d in eligible:
        if len(chosen) < settings.target and d["document_id"] not in chosen:
            chosen[d["document_id"]] = "rank fill"
    return chosen, dropped


def test_selection_against_a_greedy_loop(spark):
    rng = random.Random(6)
    docs = [
        {"document_id": i, "title": f"T{rng.randrange(45)}", "chunk_count": rng.randrange(1, 9), "kind": rng.choice(["a", "b", "z"]),
         "source_queries": rng.sample(["p", "q", "r"], rng.randrange(1, 3))}
        for i in range(80)
    ]
    settings = selection.SelectionSettings(14, 2, {"p": 3, "r": 6, "q": 4}, ["b", "a"])
    rows = spark.createDataFrame(docs, "document_id bigint, title string, chunk_count int, kind string, source_queries array<string>")
    chosen, dropped = plain_selection(docs, settings)
    got = {r.document_id: r for r in selection.select_sources(rows.repartition(3), settings).collect()}
    assert {i: r.reason for i, r in got.items() if r.status == "selected"} == chosen
    assert {i for i, r in got.items() if r.status == "duplicate_excluded"} == dropped


def test_example_plan_windows(spark):
    chunks = [(f"{d}:{i}", d, i, 100, "References x" if (d, i) == (1, 0) else "body") for d, n in ((1, 8), (2, 3), (3, 1)) for i in range(n)]
    rows = spark.createDataFrame(chunks, "chunk_id string, document_id bigint, chunk_index bigint, word_count bigint, text string")
    ids = lambda *d: spark.createDataFrame([(x,) for x in d], "document_id bigint")
    got = [(r.plan_id, r.example_type, r.document_id, r.chunk_ids) for r in selection.example_plan(rows, ids(1), ids(2)).orderBy("plan_id").collect()]
    assert got == [
        ("plan_0001", "ordinary", 1, ["1:1", "1:2"]), ("plan_0002", "ordinary", 1, ["1:6", "1:7"]),
        ("plan_0003", "synthesis", 1, ["1:3", "1:4", "1:5"]), ("plan_0004", "ordinary", 2, ["2:0", "2:1"]),
        ("plan_0005", "ordinary", 2, ["2:1", "2:2"]), ("plan_0006", "refusal", 2, ["2:0", "2:1"]),
    ]
    starts = spark.range(1).select(selection.window_starts(F.lit(8), 3, 3).alias("x"), selection.window_starts(F.lit(7), 2, 1).alias("y")).first()
    assert starts.x == [0, 2, 5] and starts.y == [2]


def test_leakage_rules(spark):
    examples = spark.createDataFrame(
        [("e1", "What is X?", "Ans", False, [1]), ("e2", "what  IS x?", "ANS", False, [2, 3]), ("p1", "new", "ans", True, [9])],
        "example_id string, query string, answer string, refused boolean, document_ids array<bigint>",
    )
    queries = spark.createDataFrame([("p2", "What is X?"), ("p1", "What is X?"), ("p3", " ")], "ref string, text string")
    answers = spark.createDataFrame([("p1", "Ans")], "ref string, text string")
    documents = spark.createDataFrame([(3,)], "document_id bigint")
    got = {tuple(r) for r in leakage.audit(examples, queries, answers, documents).collect()}
    assert got == {
        ("protected_example_id", "p1", "p1"), ("exact_query", "e1", "p1"), ("normalized_query", "e2", "p1"),
        ("exact_target_answer", "e1", "p1"), ("normalized_target_answer", "e2", "p1"), ("protected_source_document", "e2", "3"),
    }


def test_integrity(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    checks = integrity.all_of(
        integrity.duplicate_keys(rows, "dup", ["k"]), integrity.rows_where(rows, "null_v", "k", F.col("v").isNull()),
        integrity.orphans(rows, rows.where("k = 1"), "orphan", "k", "k"), integrity.varying_within(rows, "vary", "k", ["v"]),
    )
    assert {(r.check_name, r.violations) for r in integrity.summary(checks).collect()} == {("dup", 1), ("null_v", 1), ("orphan", 1), ("vary", 1)}
    with pytest.raises(ValueError, match="dup"):
        integrity.enforce(checks.where("check_name = 'dup'"))


def test_record_tables(spark):
    from citeweave.operators import record_tables as R

    row = spark.range(1).select(
        R.assistant_labels(F.array(*[F.lit(i).cast("bigint") for i in (5, 6, 7, 8)]), F.lit(2)).alias("labels"),
        R.visual_asset_id(F.lit("1:page:2"), F.lit("figure"), F.lit(3)).alias("asset"),
        R.chat_messages(F.lit("s"), F.lit("u"), F.struct(F.lit("x").alias("answer"))).alias("chat"),
    ).withColumn("n", R.supervised_tokens(F.col("labels"))).first()
    assert row.labels == [-100, -100, 7, 8] and row.n == 2 and row.asset == "1:page:2:figure:003"
    assert [(m.role, m.content) for m in row.chat] == [("system", "s"), ("user", "u"), ("assistant", '{"answer":"x"}')]


def test_long_text_ids_keep_their_components(spark):
    links = spark.createDataFrame(
        [("collection-2026-example-0001", "a"), ("collection-2026-example-0002", "b"), ("collection-2026-example-0003", "b")],
        "example_id string, document_id string",
    )
    got = {r.example_id: r.component for r in split.example_components(links).collect()}
    assert len(set(got.values())) == 2 and got["collection-2026-example-0002"] == got["collection-2026-example-0003"]


def test_unmet_minimums_are_rows(spark):
    selected = spark.createDataFrame([(1, "selected"), (2, "not_selected")], "document_id long, status string")
    documents = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"])], "document_id long, source_queries array<string>")
    settings = selection.SelectionSettings(2, 1, {"a": 1, "b": 2}, [])
    got = {(r.source_query, r.minimum, r.selected) for r in selection.selection_gaps(selected, documents, settings).collect()}
    assert got == {("b", 2, 0), (None, 3, 2)}


def test_doubled_pairs_become_one(spark):
    near = spark.createDataFrame([(1, 2, 0.5, 1), (2, 1, 0.50000001, 1)], "anchor_id long, candidate_id long, cosine_similarity double, rank int")
    assert [tuple(r) for r in pairs.hard_negatives(near).collect()] == [(1, 2, 0.50000001)]


def test_group_values_spread_a_hot_key(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), "id"
    )
    settings = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        placed = scale.with_group_values(rows, "k", ["id"], {"n": (F.count("*"), F.sum), "m": (F.min("id"), F.min)})
        largest = placed.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        got = {(r.k, r.n, r.m) for r in placed.select("k", "n", "m").distinct().collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    want = {(0, 18_000, 0)} | {(i, 1, i) for i in range(20_000) if i % 10 == 9}
    assert got == want and largest < 4_000


def test_documents_without_title_have_no_family(spark):
    rows = spark.createDataFrame(
        [(1, None, 3, "en"), (2, None, 3, "en"), (3, "A b", 3, "en"), (4, "a  B", 9, "en")],
        "document_id bigint, title string, chunk_count int, kind string",
    )
    got = {r.document_id: r.duplicate_excluded for r in selection.title_families(rows, ["en"]).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_request_outcomes(spark):
    retrieved = spark.createDataFrame(
        [(1, []), (2, ["E1"]), (3, ["E1"]), (4, ["E1"]), (5, ["E1"])], "request_id int, evidence_ids array<string>"
    )
    generated = spark.createDataFrame(
        [(2, ["E1"], False), (3, ["E9"], False), (4, [], True)], "request_id int, cited_evidence_ids array<string>, refused boolean"
    )
    got = {r.request_id: r.termination_reason for r in agents.safe_outcome(retrieved, generated).collect()}
    assert got == {
        1: "grounded_refusal", 2: "answer_completed", 3: "citation_validation_failure", 4: "grounded_refusal",
        5: "dependency_failure",
    }
