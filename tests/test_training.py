"""Training rows, drafted questions, frozen evidence, protected manifests and the document-key split."""

import hashlib

import pytest
from pyspark.sql import functions as F

from citeweave.operators import protected, rules, split, training_rows

EVIDENCE = "array<struct<evidence_id:string,chunk_id:string,document_id:bigint,text:string>>"
ROW = f"example_id string, query string, max_claims int, insufficient_evidence boolean, evidence {EVIDENCE}, claims array<struct<text:string,evidence_ids:array<string>>>"


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_training_rows_report_all_their_flaws(spark):
    good = [("E1", "a", 1, "x"), ("E2", "b", 1, "y")]
    rows = [
        ("supported", "q", 2, False, good, [("c", ["E1", "E2"])]),
        ("refused", "q", 2, True, good, []),
        ("same ids", "q", 2, False, [("E1", "a", 1, "x"), ("E1", "b", 1, "y")], [("c", ["E1"])]),
        ("same chunks", "q", 2, False, [("E1", "a", 1, "x"), ("E2", "a", 1, "y")], [("c", ["E1"])]),
        ("unknown", "q", 2, False, good, [("c", ["E1"]), ("d", ["E9", "E2", "E8"])]),
        ("no claims", "q", 2, False, good, []),
        ("refusal with claims", "q", 2, True, good, [("c", ["E7", "E7"])]),
        ("many", " ", 1, False, [("E1", "a", 0, " ")], [("c", []), ("d", ["E1", "E1"])]),
        ("nulls", None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, ROW)
    broken = found(rules.violations(table, "example_id", training_rows.example_rules()), "example_id", "check_name", "detail")
    assert [b for b in broken if b[0] not in ("many", "nulls")] == [
        ("no claims", "answer_without_claims", "0"), ("refusal with claims", "refusal_with_claims", "1"),
        ("same chunks", "chunk_id_repeated", "a"), ("same ids", "evidence_id_repeated", "E1"),
        ("unknown", "claim_evidence_unknown", "2 E8,E9"),
    ]
    assert [b[1:] for b in broken if b[0] == "many"] == [
        ("claim_evidence_repeated", "2 E1"), ("claim_without_evidence", "1 0"), ("evidence_document_not_positive", "1"),
        ("evidence_text_blank", "1"), ("query_blank", ""), ("too_many_claims", "2"),
    ]
    assert {"query_blank", "evidence_missing", "max_claims_range"} <= {b[1] for b in broken if b[0] == "nulls"}
    assert found(rules.sound(table, training_rows.example_rules()), "example_id") == [("refused",), ("supported",)]
    assert rules.violations(table.limit(0), "example_id", training_rows.example_rules()).count() == 0
    with pytest.raises(ValueError):
        rules.violations(table, "example_id", training_rows.example_rules() * 2)


def test_synthesis_needs_two_claims_and_two_pieces(spark):
    rows = [("one", [("c", ["E1", "E2"])]), ("same", [("c", ["E1"]), ("d", ["E1"])]), ("good", [("c", ["E1"]), ("d", ["E2"])])]
    table = spark.createDataFrame(rows, "example_id string, claims array<struct<text:string,evidence_ids:array<string>>>")
    assert found(rules.violations(table, "example_id", training_rows.synthesis_rules()), "example_id", "check_name") == [
        ("one", "synthesis_claims"), ("same", "synthesis_evidence")
    ]


def test_question_rules(spark):
    rows = [
        (1, 77, "What does  the wing\nspan measure?"), (2, 77, "Why?"), (3, 77, "What does the wing measure"),
        (4, 77, "What does e12 say about the wing?"), (5, 77, "What is in a:CHUNK:b about wings?"), (6, 77, "What is document 77 about now?"),
        (7, 77, "Based on the Evidence, what is a wing?"), (8, 77, "What " + "x" * 80 + "?"), (9, 77, "Are the 12 sites E-1 and EE12 known?"),
    ]
    table = spark.createDataFrame(rows, "id int, document_id int, text string").withColumn("t", training_rows.normal_question(F.col("text")))
    broken = rules.violations(table, "id", training_rows.question_rules(F.col("t"), F.col("document_id"), 10, 60))
    assert found(broken, "id", "check_name") == [
        (2, "question_short"), (3, "question_mark_missing"), (4, "question_names_evidence"), (5, "question_names_chunk"),
        (6, "question_names_document"), (7, "question_meta_language"), (8, "question_long"),
    ]


def test_plan_evidence_keeps_order_and_names_problems(spark):
    plans = spark.createDataFrame(
        [("good", 1, ["c3", "c1", "c3"]), ("missing", 1, ["c1", "c9"]), ("foreign", 1, ["c1", "c2"]), ("unselected", 5, ["c1"]),
         ("protected", 2, ["c2"]), ("bare", 1, [])],
        "plan_id string, document_id int, chunk_ids array<string>",
    ).repartition(3)
    chunks = spark.createDataFrame([("c1", 1, "one"), ("c2", 2, "two"), ("c3", 1, "three")], "chunk_id string, document_id int, text string")
    chosen, barred = spark.createDataFrame([(1,), (2,), (2,)], "document_id int"), spark.createDataFrame([(2,)], "document_id int")
    lines = training_rows.resolve_evidence(plans, chunks, chosen, barred)
    assert found(lines.where("problem IS NOT NULL"), "plan_id", "position", "problem") == [
        ("foreign", 2, "chunk_of_other_document"), ("missing", 2, "chunk_missing"), ("protected", 1, "document_protected"),
        ("unselected", 1, "document_not_selected"),
    ]
    (row,) = training_rows.resolved_plans(lines).collect()
    assert row.plan_id == "good" and [(e.evidence_id, e.chunk_id, e.text) for e in row.evidence] == [
        ("E1", "c3", "three"), ("E2", "c1", "one"), ("E3", "c3", "three")
    ]


def manifest(spark, header=(1, 2, 2, 2), queries=("q1",), refs=(("q1", "document", "4"), ("q1", "chunk", "a"), ("q1", "document", "5"), ("q1", "chunk", "b")),
             listed=(("document", "4"), ("document", "5"), ("chunk", "a"), ("chunk", "b"))):
    return protected.violations(
        spark.createDataFrame([(7, *header)], "manifest_id int, query_count int, document_count int, chunk_count int, evidence_top_k int"),
        spark.createDataFrame([(7, q) for q in queries], "manifest_id int, query_id string"),
        spark.createDataFrame([(7, *r) for r in refs], "manifest_id int, query_id string, kind string, id string"),
        spark.createDataFrame([(7, *r) for r in listed], "manifest_id int, kind string, id string"),
    )


def test_protected_manifest_rules(spark):
    columns = ("check_name", "row_key", "detail")
    assert found(manifest(spark), *columns) == []
    assert found(manifest(spark, header=(3, 2, 2, 2)), *columns) == [("query_count", "7", "3 found 1")]
    assert found(manifest(spark, header=(2, 2, 2, 2), queries=("q1", "q1")), *columns) == [("duplicate_query", "q1", "2")]
    assert found(manifest(spark, header=(1, 2, 2, 3)), *columns) == [("evidence_size", "q1", "2")]
    assert found(manifest(spark, header=(1, 1, 2, 2), listed=(("document", "4"), ("chunk", "a"), ("chunk", "b"))), *columns) == [
        ("unknown_document", "5", "")
    ]
    assert found(manifest(spark, header=(1, 4, 2, 2), listed=(
        ("document", "4"), ("document", "5"), ("document", "5"), ("document", "0"), ("chunk", "a"), ("chunk", "b"))), *columns) == [
        ("document_not_positive", "0", ""), ("duplicate_document", "5", "2"), ("unused_document", "0", "")
    ]


def test_equal_sets_are_not_compared_one_by_one(spark):
    left = spark.range(2000).select(F.lit(1).alias("manifest_id"), F.lit("chunk").alias("kind"), F.col("id").cast("string"))
    assert protected.differing_sets(left, left.repartition(5)).count() == 0
    assert found(protected.differing_sets(left, left.where("id <> '77'")), "manifest_id", "kind") == [(1, "chunk")]


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_document_order_is_that_of_the_joined_ids(spark, monkeypatch, piece):
    """A component with nine tenths of all ids and some small ones; ids sort as numbers and join as text."""
    monkeypatch.setattr(split, "PIECE", piece)
    held = [(f"x{i % 40}", "big", i) for i in range(900)] + [(f"y{i}", f"small{i % 7}", 1000 + i % 50) for i in range(100)]
    owner = {}
    held = [(e, owner.setdefault(d, c), d) for e, c, d in held]  # a document is in one component
    table = spark.createDataFrame(held, "example_id string, component string, document_id long").repartition(5)
    members = table.select("example_id", "component").distinct()
    got = {r.component: r for r in split.document_order(table.select("example_id", "document_id"), members, 9).collect()}
    sets = {}
    for _, component, document in held:
        sets.setdefault(component, set()).add(document)
    for component, ids in sets.items():
        key = ",".join(str(i) for i in sorted(ids))
        assert got[component].fraction == int.from_bytes(hashlib.sha256(f"9:{key}".encode()).digest()[:8], "big") / 2.0**64
        assert got[component].component_key == f"{min(ids)},"


def test_split_by_document_order(spark):
    rows = [(f"k{c}-{j}", f"k{c}", c) for c in range(20) for j in range(1 + c % 3)]
    links = spark.createDataFrame([(e, d) for e, _, d in rows], "example_id string, document_id int")
    members = spark.createDataFrame([(e, c) for e, c, _ in rows], "example_id string, component string")
    order = sorted(range(20), key=lambda c: (int.from_bytes(hashlib.sha256(f"3:{c}".encode()).digest()[:8], "big"), f"{c},"))
    target, cumulative, best = max(1, min(len(rows) - 1, round(len(rows) * 0.3))), 0, (None, 1)
    for prefix in range(1, 20):
        cumulative += 1 + order[prefix - 1] % 3
        if best[0] is None or abs(cumulative - target) < best[0]:
            best = (abs(cumulative - target), prefix)
    got = split.split(members, 0.3, 3, split.document_order(links, members, 3))
    assert {r.component for r in got.where("side = 'dev'").collect()} == {f"k{c}" for c in order[: best[1]]}
    assert got.count() == len(rows)


def test_manifest_rules_read_the_references_twice_at_most(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        read.add(1)
        return value

    rows = [(1, q, kind, i) for q in (1, 2) for kind, i in (("chunk", "5"), ("chunk", None), ("document", f"{q}"))]
    refs = spark.createDataFrame(rows, "manifest_id int, query_id int, kind string, id string").withColumn("id", seen("id"))
    listed = spark.createDataFrame(
        [(1, "chunk", "5"), (1, "chunk", None), (1, "chunk", "6"), (1, "chunk", "6"), (1, "document", "1"), (1, "document", "2")],
        "manifest_id int, kind string, id string",
    )
    headers = spark.createDataFrame([(1, 2, 2, 4, 2)], "manifest_id int, query_count int, document_count int, chunk_count int, evidence_top_k int")
    queries = spark.createDataFrame([(1, 1), (1, 2)], "manifest_id int, query_id int")
    got = {(r.check_name, r.row_key) for r in protected.violations(headers, queries, refs, listed).collect()}
    # A missing id equals none, so it is both unknown and unused where the sets differ otherwise.
    assert got == {("duplicate_chunk", "6"), ("unused_chunk", "6"), ("unused_chunk", None), ("unknown_chunk", None)}
    assert read.value <= 2 * len(rows)
