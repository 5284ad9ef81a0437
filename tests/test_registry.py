import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "bm25_top10", "facet_mix", "grounded_answers", "adaptive_two_pass", "chunk_pages", "threshold_sweep", "rate_limiter",
    "source_selection", "train_dev_split", "review_units",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in "events documents embeddings benchmark labels conversations pages part".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
    assert sorted(names) == columns and got == want


def test_results_do_not_depend_on_partitioning(spark):
    before = sorted(map(repr, entry.queries()["bm25_top10"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(map(repr, entry.queries()["bm25_top10"](spark, SF).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
