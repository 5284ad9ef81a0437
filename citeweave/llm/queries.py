"""Registered queries: each applies one operator to its whole table; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import (
    decontaminate, divergence, language, merkle, minhash, ngram_join, quality, secret_scan, sentencepieces, sharding, substring, topk,
    toxicity,
)
from citeweave.llm.common import fold, one_label, table
from citeweave.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BASE_KINDS = [r.kind for r in secret_scan.BASE_RULES]


def query(name: str, oracle: str | None = None):
    def register(build):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint")


@query("op1_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")})
    base = F.filter("findings", lambda f: f["kind"].isin(BASE_KINDS))
    return found.select(
        "doc_id",
        *[_of_kind(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("findings")).alias("spans"),
    )


TOPK_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""


@query("op2_exact_topk", TOPK_SQL)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.integers("embedding").alias("v"))
    return topk.search(vectors.where("id % 100 = 0"), vectors, 10)


@query("op3_sharding")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.assign(docs, ["lang", "source", "text", "doc_id"], 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_toxicity")
def toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    labels = one_label(table(spark, sf_dir, "labels").where(~held_out), "doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out}).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence"
    )


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.c = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op5_ngram_join", JACCARD_SQL)
def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_language")
def bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op8_sentencepiece")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepieces.load(PIECES)
    decoded = sentencepieces.round_trip(table(spark, sf_dir, "documents"), vocabulary, {"doc_id": F.col("doc_id")})
    return decoded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), "ids",
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op9_quality")
def positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    positives = one_label(table(spark, sf_dir, "labels").where(~held_out), "doc_id", "quality").where("y = 1")
    scored = quality.classify(docs, positives, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS place FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE place > 1),
per AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(per.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(
    CASE WHEN per.n IS NULL THEN w.w ELSE list_filter(w.w, lambda x, k: NOT list_contains(per.gone, k)) END, ' '), ''))
  AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""


@query("op10_substring_dedup", SUBSTRING_SQL)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"))


MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.c = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op11_minhash_dedup", MINHASH_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = minhash.groups(table(spark, sf_dir, "documents"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def merkle_sql(levels: int = 5) -> str:
    """SQL for trees of at most 16**levels leaves. A level repeats a tree of one node as it is."""

    def raised(prefix: str) -> str:
        return "".join(f"""
{prefix}{k + 1} AS (
  SELECT tree, place // 16 AS place, any_value((total + 15) // 16) AS total,
    CASE WHEN any_value(total) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest
  FROM {prefix}{k} GROUP BY tree, place // 16),""" for k in range(levels))

    def sides(prefix: str, tree: str, place: str, first: int) -> str:
        columns = []
        for k in range(levels):
            near = f"FROM {prefix}{k} x WHERE x.tree = {tree} AND x.place // 16 = {place} // {16 ** (k + 1)} AND x.total > 1"
            for name, sign in (("b", "<"), ("a", ">")):
                at = f"x.place {sign} {place} // {16 ** k}"
                columns.append(f"coalesce((SELECT string_agg(x.digest, '' ORDER BY x.place) {near} AND {at}), '') AS {name}{first + k}")
        return ", ".join(columns)

    crc = "xor(c >> 1, 3988292384 * (c & 1))"
    shifted = f"list_reduce(list_concat([xor(s, x)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {crc})"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc32 = f"xor(list_reduce(list_concat([4294967295], {codes}), lambda s, x: {shifted}), 4294967295)"

    def part(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    head = " || ".join(part(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    siblings = sides("l", "d.tree", "d.place", 0) + ", " + sides("t", "''", "r.place", levels)
    folds = ", ".join(
        f"f{k + 1} AS (SELECT *, CASE WHEN n{k} > 1 THEN sha256(b{k} || h{k} || a{k}) ELSE h{k} END AS h{k + 1} FROM f{k})"
        for k in range(2 * levels)
    )
    sizes = ", ".join(f"(d.total + {16 ** k - 1}) // {16 ** k} AS n{k}" for k in range(levels))
    top_sizes = ", ".join(f"(r.total + {16 ** k - 1}) // {16 ** k} AS n{k + levels}" for k in range(levels))
    proof = " || ".join(f"b{k} || a{k}" for k in range(2 * levels))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('+' || source, '') AS tree, sha256({head} || {part("text")}) AS leaf,
    sha256({head} || CASE WHEN {crc32} % 5 = 0 THEN {part(lower)} ELSE {part("text")} END) AS seen FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS total FROM d),
l0 AS (SELECT tree, place, total, leaf AS digest FROM leaves),{raised("l")}
t0 AS (
  SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total, digest, tree AS source_tree
  FROM l{levels}),{raised("t")}
f0 AS (
  SELECT d.doc_id, d.leaf, r.digest AS subroot, d.seen AS h0, {siblings}, {sizes}, {top_sizes}
  FROM leaves d JOIN t0 r ON r.source_tree = d.tree),
{folds}
SELECT doc_id, leaf, subroot, t.digest AS root, sha256({proof}) AS proof_sha256, h{2 * levels} AS folded_root,
  h{2 * levels} = t.digest AS verified
FROM f{2 * levels} CROSS JOIN t{levels} t
"""


@query("op12_merkle_manifest", merkle_sql())
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocabulary AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
langs AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, o.term, coalesce(c.c, 0) AS c, o.total, l.n AS whole, l.v,
    1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p
  FROM groups g JOIN vocabulary o ON o.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = o.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
telling AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value
  FROM (SELECT *, 1 + (1000000000 * (total + 1)) // (whole + v) AS q FROM shares) WHERE c > 0 AND p > q),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM telling),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
