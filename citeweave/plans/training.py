"""Registered queries of training rows: invariants, drafted questions, frozen evidence and protected manifests.

Orders stand for examples and plans, their lines for evidence and claims, customers for manifests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators import dense, protected, rules, training_rows
from citeweave.plans import sql as S
from citeweave.plans import tables as P
from citeweave.plans.registry import query
from citeweave.plans.retrieval import DENSE_TOP, embedding_sides
from citeweave.session import stored, stored_table

# --- examples ----------------------------------------------------------------

_EXAMPLE_SQL = """e AS (SELECT o.o_orderkey AS example_id, o_orderpriority AS query, 1 + o_custkey % 6 AS max_claims, o_orderstatus = 'P' AS refused,
      o_custkey % 4 = 0 AS is_synthesis,
      coalesce(list({'eid': 'E' || (l_linenumber - (l_quantity % 10 = 0)::INT), 'chunk': l_partkey // 4, 'doc': l_suppkey}
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (WHERE l_orderkey IS NOT NULL), []) AS ev,
      coalesce(list(CASE WHEN l_discount = 0.1 THEN [] ELSE ['E' || l_linenumber, 'E' || (1 + l_suppkey % 7)] END
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (WHERE l_returnflag = 'A'), []) AS cl
    FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _flaw(name: str, broken: str, detail: str = "''") -> str:
    return f"SELECT example_id, '{name}' AS check_name, {detail} AS detail FROM e WHERE {broken}"


def _again(values: str) -> str:
    return f"list_sort(list_distinct(list_filter({values}, lambda v, i: list_position({values}, v) < i)))"


def _places(condition: str, detail: str) -> str:
    """Places of the claims that break a condition on ``c``, each with its detail."""
    broken = f"list_transform(cl, lambda c, i: CASE WHEN {condition} THEN concat_ws(' ', i, nullif({detail}, '')) END)"
    return f"array_to_string(list_filter({broken}, lambda x: x IS NOT NULL), ';')"


_IDS, _CHUNKS = "list_transform(ev, lambda x: x.eid)", "list_transform(ev, lambda x: x.chunk::VARCHAR)"
_UNKNOWN = f"list_distinct(list_filter(c, lambda v: NOT list_contains({_IDS}, v)))"
_CITED = "list_distinct(flatten(cl))"
_LOW = "array_to_string(list_filter(list_transform(ev, lambda x, i: CASE WHEN x.doc < 1 THEN i::VARCHAR END), lambda v: v IS NOT NULL), ';')"


def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example per order; its lines are the evidence, returned lines the claims (at most seven each)."""
    lines = P.table(spark, sf_dir, "lineitem")
    place = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    shifted = F.col("l_linenumber") - (F.col("l_quantity") % 10 == 0).cast("int")
    evidence = F.struct(
        F.concat(F.lit("E"), shifted).alias("evidence_id"), F.floor(F.col("l_partkey") / 4).alias("chunk_id"),
        F.col("l_suppkey").alias("document_id"), F.col("l_returnflag").alias("text"),
    )
    cited = F.when(F.col("l_discount") == 0.1, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("E"), "l_linenumber"), F.concat(F.lit("E"), 1 + F.col("l_suppkey") % 7))
    )
    claim = F.when(F.col("l_returnflag") == "A", F.struct(F.col("l_linestatus").alias("text"), cited.alias("evidence_ids")))
    grouped = lines.groupBy(F.col("l_orderkey").alias("example_id")).agg(
        F.array_sort(F.collect_list(F.struct(*place, evidence.alias("e"), claim.alias("c")))).alias("rows")
    )
    orders = P.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("example_id"), F.col("o_orderpriority").alias("query"), (1 + F.col("o_custkey") % 6).alias("max_claims"),
        (F.col("o_orderstatus") == "P").alias("insufficient_evidence"), (F.col("o_custkey") % 4 == 0).alias("is_synthesis"),
    )
    kinds = {"e": "array<struct<evidence_id:string,chunk_id:bigint,document_id:bigint,text:string>>", "c": "array<struct<text:string,evidence_ids:array<string>>>"}
    return orders.join(grouped, "example_id", "left").select(
        *orders.columns, F.coalesce(F.col("rows")["e"], F.array().cast(kinds["e"])).alias("evidence"),
        F.coalesce(F.filter(F.col("rows")["c"], lambda c: c.isNotNull()), F.array().cast(kinds["c"])).alias("claims"),
    )


@query(
    "training_row_violations",
    "WITH " + _EXAMPLE_SQL + " " + " UNION ALL ".join([
        _flaw("evidence_missing", "len(ev) = 0", "'0'"),
        _flaw("evidence_document_not_positive", f"{_LOW} <> ''", _LOW),
        _flaw("evidence_id_repeated", f"len({_again(_IDS)}) > 0", f"array_to_string({_again(_IDS)}, ',')"),
        _flaw("chunk_id_repeated", f"len({_again(_CHUNKS)}) > 0", f"array_to_string({_again(_CHUNKS)}, ',')"),
        _flaw("too_many_claims", "len(cl) > max_claims", "len(cl)::VARCHAR"),
        _flaw("refusal_with_claims", "refused AND len(cl) > 0", "len(cl)::VARCHAR"),
        _flaw("answer_without_claims", "NOT refused AND len(cl) = 0", "'0'"),
        *[
            _flaw(name, f"NOT refused AND {_places(condition, detail)} <> ''", _places(condition, detail))
            for name, condition, detail in (
                ("claim_without_evidence", "len(c) = 0", "'0'"),
                ("claim_evidence_repeated", f"len({_again('c')}) > 0", f"array_to_string({_again('c')}, ',')"),
                ("claim_evidence_unknown", f"len({_UNKNOWN}) > 0", f"array_to_string(list_sort({_UNKNOWN}), ',')"),
            )
        ],
        _flaw("synthesis_claims", "is_synthesis AND len(cl) < 2", "len(cl)::VARCHAR"),
        _flaw("synthesis_evidence", f"is_synthesis AND len({_CITED}) < 2", f"len({_CITED})::VARCHAR"),
    ]),
)
def training_row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = training_rows.example_rules() + training_rows.synthesis_rules(needed=F.col("is_synthesis"))
    return rules.violations(training_examples(spark, sf_dir), "example_id", declared)


_QUESTION_SQL = f"""q AS (SELECT *, {S.collapse('text')} AS t, {S.fold(S.collapse('text'))} AS folded FROM (
      SELECT conv_id || '/' || turn AS question_id, conv_id AS document_id, text || CASE WHEN turn % 3 = 0 THEN ' ?' ELSE '' END
        || CASE WHEN conv_id % 5 = 0 THEN ' See e' || turn || ' in the Provided  Evidence' WHEN conv_id % 5 = 1 THEN ' 7:Chunk:3?' ELSE '' END AS text
      FROM conversations)),
    p AS (SELECT *, list_filter([{', '.join(f"'{p}'" for p in training_rows.META_PHRASES)}], lambda x: contains(folded, x)) AS named FROM q)"""


def drafted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as drafted questions about the document with the conversation's number."""
    turn, group = F.col("turn"), F.col("conv_id") % 5
    tail = F.concat(
        F.when(turn % 3 == 0, " ?").otherwise(""),
        F.when(group == 0, F.concat(F.lit(" See e"), turn, F.lit(" in the Provided  Evidence"))).when(group == 1, " 7:Chunk:3?").otherwise(""),
    )
    rows = P.table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("question_id"), F.col("conv_id").alias("document_id"), F.concat("text", tail).alias("text")
    )
    return rows.withColumn("question", training_rows.normal_question(F.col("text")))


@query(
    "question_violations",
    f"""WITH {_QUESTION_SQL} SELECT question_id, check_name, detail FROM (
        SELECT question_id, 'question_short' AS check_name, length(t)::VARCHAR AS detail FROM p WHERE length(t) < 20
        UNION ALL SELECT question_id, 'question_long', length(t)::VARCHAR FROM p WHERE length(t) > 400
        UNION ALL SELECT question_id, 'question_mark_missing', '' FROM p WHERE NOT ends_with(t, '?')
        UNION ALL SELECT question_id, 'question_names_evidence', regexp_extract(t, '(?i)\\bE\\d+\\b') FROM p WHERE regexp_matches(t, '(?i)\\bE\\d+\\b')
        UNION ALL SELECT question_id, 'question_names_chunk', regexp_extract(t, '(?i):chunk:') FROM p WHERE regexp_matches(t, '(?i):chunk:')
        UNION ALL SELECT question_id, 'question_names_document', '' FROM p WHERE contains(t, document_id::VARCHAR)
        UNION ALL SELECT question_id, 'question_meta_language', array_to_string(named, ',') FROM p WHERE len(named) > 0)""",
)
def question_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = training_rows.question_rules(F.col("question"), F.col("document_id"), 20, 400)
    return rules.violations(drafted_questions(spark, sf_dir), "question_id", declared)


# --- frozen evidence ---------------------------------------------------------

_PLAN_SQL = """plan AS (SELECT o_orderkey AS plan_id, o_custkey % 7 AS document_id FROM orders),
    line AS (SELECT l_orderkey AS plan_id, l_partkey AS chunk_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem),
    part_chunk AS (SELECT p_partkey AS chunk_id, p_partkey % 7 AS owner, p_name AS text FROM part WHERE p_size <= 45),
    resolved AS (SELECT plan_id, position::INT AS position, 'E' || position AS evidence_id, chunk_id, document_id, text,
      CASE WHEN document_id NOT IN (SELECT r_regionkey FROM region) THEN 'document_not_selected'
        WHEN document_id IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') THEN 'document_protected'
        WHEN position IS NOT NULL AND owner IS NULL THEN 'chunk_missing'
        WHEN position IS NOT NULL AND owner <> document_id THEN 'chunk_of_other_document' END AS problem
      FROM plan LEFT JOIN line USING (plan_id) LEFT JOIN part_chunk USING (chunk_id))"""


def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans over the parts of their lines, in line order, resolved."""
    place = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    lists = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id")).agg(
        F.array_sort(F.collect_list(F.struct(*place)))["l_partkey"].alias("chunk_ids")
    )
    plans = P.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") % 7).alias("document_id")
    ).join(lists, "plan_id", "left")
    parts = P.table(spark, sf_dir, "part").where("p_size <= 45").select(
        F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 7).alias("document_id"), F.col("p_name").alias("text")
    )
    regions = P.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("document_id"), "r_name")
    return training_rows.resolve_evidence(plans, parts, regions, regions.where("r_name = 'ASIA'"))


@query("plan_evidence", f"WITH {_PLAN_SQL} SELECT * FROM resolved")
def plan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_lines(spark, sf_dir)


@query(
    "resolved_plans",
    f"""WITH {_PLAN_SQL} SELECT plan_id, document_id, to_json(list({{'evidence_id': evidence_id, 'chunk_id': chunk_id, 'document_id': document_id, 'text': text}} ORDER BY position))::VARCHAR AS evidence
        FROM resolved GROUP BY ALL HAVING count(problem) = 0 AND count(position) > 0""",
)
def resolved_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows.resolved_plans(plan_lines(spark, sf_dir)).withColumn("evidence", F.to_json("evidence"))


# --- protected manifests -----------------------------------------------------


@query(
    "protected_manifest",
    f"""WITH hits AS ({DENSE_TOP}), entries AS (
        SELECT query_id, label < 5 AS expected_answerable, list_sort(list(DISTINCT chunk_id // 10)) AS document_ids, list(chunk_id ORDER BY rank) AS chunk_ids
        FROM hits JOIN embeddings ON vec_id = query_id WHERE rank <= 5 GROUP BY ALL)
      SELECT kind, id FROM (SELECT 'document' AS kind, unnest(document_ids)::VARCHAR AS id FROM entries
        UNION SELECT 'chunk', unnest(chunk_ids)::VARCHAR FROM entries)
      UNION ALL SELECT 'query', query_id || ' ' || CASE WHEN expected_answerable THEN 'true' ELSE 'false' END || ' ' || array_to_string(document_ids, ',') || ' ' || array_to_string(chunk_ids, ',') FROM entries""",
)
def protected_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector as its evidence; ten neighbouring ids are one document."""
    corpus, asked = embedding_sides(spark, sf_dir)
    hits = dense.search(corpus, asked, 5).withColumn("document_id", F.floor(F.col("chunk_id") / 10))
    labels = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") < 5).alias("expected_answerable"))
    entries = stored(protected.build(hits, labels))
    texts = [F.array_join(F.col(c).cast("array<string>"), ",") for c in ("document_ids", "chunk_ids")]
    per_query = entries.select(
        F.lit("query").alias("kind"), F.concat_ws(" ", F.col("query_id").cast("string"), F.col("expected_answerable").cast("string"), *texts).alias("id")
    )
    return protected.members(entries).unionByName(per_query)


_MANIFEST_SQL = """asked AS (SELECT o_custkey AS manifest_id, o_orderkey // CASE WHEN o_custkey % 13 = 0 THEN 4 ELSE 1 END AS query_id FROM orders),
    refs AS (SELECT DISTINCT o_custkey AS manifest_id, o_orderkey // CASE WHEN o_custkey % 13 = 0 THEN 4 ELSE 1 END AS query_id,
        unnest(['chunk', 'document']) AS kind, unnest([l_partkey, l_suppkey])::VARCHAR AS id, l_discount FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    listed AS (SELECT manifest_id, kind, id, count(*) AS n FROM (
        SELECT DISTINCT manifest_id, kind, id FROM refs WHERE NOT (manifest_id % 3 = 0 AND l_discount = 0.1)
        UNION ALL SELECT c_custkey, 'chunk', '0' FROM customer WHERE c_custkey % 7 = 0
        UNION ALL SELECT c_custkey, 'document', c_nationkey::VARCHAR FROM customer WHERE c_custkey % 11 = 0) GROUP BY ALL),
    head AS (SELECT c_custkey AS manifest_id, 2 + c_custkey % 3 AS evidence_top_k, coalesce(q.n, 0) + (c_custkey % 17 = 0)::INT AS query_count,
        coalesce(l.d, 0) AS document_count, coalesce(l.c, 0) + (c_custkey % 19 = 0)::INT AS chunk_count
      FROM customer LEFT JOIN (SELECT manifest_id, count(*) AS n FROM asked GROUP BY 1) q ON q.manifest_id = c_custkey
      LEFT JOIN (SELECT manifest_id, sum(n) FILTER (WHERE kind = 'document') AS d, sum(n) FILTER (WHERE kind = 'chunk') AS c FROM listed GROUP BY 1) l ON l.manifest_id = c_custkey),
    used AS (SELECT DISTINCT manifest_id, kind, id FROM refs)"""


@query(
    "protected_manifest_violations",
    f"""WITH {_MANIFEST_SQL} SELECT manifest_id, check_name, row_key, detail FROM (
      SELECT manifest_id, 'duplicate_query' AS check_name, query_id::VARCHAR AS row_key, count(*)::VARCHAR AS detail FROM asked GROUP BY manifest_id, query_id HAVING count(*) > 1
      UNION ALL SELECT manifest_id, 'query_count', manifest_id::VARCHAR, query_count || ' found ' || (query_count - 1) FROM head WHERE manifest_id % 17 = 0
      UNION ALL SELECT manifest_id, 'chunk_count', manifest_id::VARCHAR, chunk_count || ' found ' || (chunk_count - 1) FROM head WHERE manifest_id % 19 = 0
      UNION ALL SELECT manifest_id, 'duplicate_' || kind, id, n::VARCHAR FROM listed WHERE n > 1
      UNION ALL SELECT manifest_id, 'document_not_positive', id, '' FROM listed WHERE kind = 'document' AND id::BIGINT < 1
      UNION ALL SELECT manifest_id, 'evidence_size', query_id::VARCHAR, coalesce(n, 0)::VARCHAR
        FROM (SELECT DISTINCT * FROM asked) LEFT JOIN (SELECT manifest_id, query_id, count(DISTINCT id) AS n FROM refs WHERE kind = 'chunk' GROUP BY 1, 2) USING (manifest_id, query_id)
        JOIN head USING (manifest_id) WHERE coalesce(n, 0) <> evidence_top_k
      UNION ALL SELECT manifest_id, 'unknown_' || kind, id, '' FROM used ANTI JOIN listed USING (manifest_id, kind, id)
      UNION ALL SELECT manifest_id, 'unused_' || kind, id, '' FROM listed ANTI JOIN used USING (manifest_id, kind, id))""",
)
def protected_manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as manifests, orders as queries, parts and suppliers as evidence; some lists are wrong."""
    orders, customers = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "customer")
    merged = F.floor(F.col("o_orderkey") / F.when(F.col("o_custkey") % 13 == 0, 4).otherwise(1))
    asked = orders.select(F.col("o_custkey").alias("manifest_id"), merged.alias("query_id"))
    lines = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_discount")
    pairs = F.array(
        F.struct(F.lit("chunk").alias("kind"), F.col("l_partkey").cast("string").alias("id")),
        F.struct(F.lit("document").alias("kind"), F.col("l_suppkey").cast("string").alias("id")),
    )
    struck = (F.col("manifest_id") % 3 == 0) & (F.col("l_discount") == 0.1)
    refs = orders.join(lines, "o_orderkey").select(
        F.col("o_custkey").alias("manifest_id"), merged.alias("query_id"), "l_discount", F.explode(pairs).alias("p")
    ).select("manifest_id", "query_id", "p.kind", "p.id", (~struck).alias("listed"))
    # Written once: the references and the lists are read by several rules.
    refs = stored_table(refs.groupBy("manifest_id", "query_id", "kind", "id").agg(F.max("listed").alias("listed")))
    key = F.col("c_custkey")
    listed = stored_table(refs.where("listed").select("manifest_id", "kind", "id").distinct())
    listed = listed.unionByName(customers.where(key % 7 == 0).select(key.alias("manifest_id"), F.lit("chunk").alias("kind"), F.lit("0").alias("id")))
    listed = listed.unionByName(customers.where(key % 11 == 0).select(
        key.alias("manifest_id"), F.lit("document").alias("kind"), F.col("c_nationkey").cast("string").alias("id")
    ))
    counts = asked.groupBy("manifest_id").agg(F.count("*").alias("q"))
    sizes = listed.groupBy("manifest_id").agg(F.count_if(F.col("kind") == "document").alias("d"), F.count_if(F.col("kind") == "chunk").alias("c"))
    heads = customers.select(key.alias("manifest_id")).join(counts, "manifest_id", "left").join(sizes, "manifest_id", "left")
    number = F.col("manifest_id")
    heads = heads.select(
        "manifest_id", (2 + number % 3).alias("evidence_top_k"), (F.coalesce("q", F.lit(0)) + (number % 17 == 0).cast("int")).alias("query_count"),
        F.coalesce("d", F.lit(0)).alias("document_count"), (F.coalesce("c", F.lit(0)) + (number % 19 == 0).cast("int")).alias("chunk_count"),
    )
    return protected.violations(heads, asked, refs.drop("listed"), listed)
