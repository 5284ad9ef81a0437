"""Registered queries of corpus building, curation and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import hashing
from citeweave.functions import text as T
from citeweave.operators import chunking, integrity, leakage, record_tables, selection, split
from citeweave.plans import sql as S
from citeweave.plans import tables as P
from citeweave.plans.registry import query
from citeweave.session import stored
from citeweave.sources import catalog, index_store

# --- text functions over whole tables ----------------------------------------


@query(
    "token_statistics",
    f"""SELECT doc_id, len({S.lexical('text')}) AS lexical_tokens, len(list_distinct({S.lexical('text')})) AS lexical_terms,
        len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS simple_tokens, len(list_distinct({S.stemmed('text')})) AS stems,
        len({S.words('text')}) AS words FROM documents""",
)
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return P.documents(spark, sf_dir).select(
        "doc_id", F.size(T.lexical_tokens(text)).alias("lexical_tokens"),
        F.size(F.array_distinct(T.lexical_tokens(text))).alias("lexical_terms"),
        F.size(T.simple_tokens(text)).alias("simple_tokens"), F.size(T.distinct_stems(text)).alias("stems"),
        F.size(T.words(text)).alias("words"),
    )


@query(
    "page_normalize",
    r"""SELECT page_id, length(t) AS character_count, t AS text FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
        array_to_string(list_transform(string_split(regexp_replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '\r\n|\r', chr(10), 'g'), chr(10)),
          lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '') AS t FROM pages)""",
)
def page_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages with tags turned into line breaks, then page normalization."""
    rows = P.spread(P.table(spark, sf_dir, "pages")).select(
        "page_id", T.normalize_page_text(F.regexp_replace("html", "<[^>]+>", "\n")).alias("text")
    )
    return rows.select("page_id", F.length("text").alias("character_count"), "text")


# Character references that occur in the raw pages.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _title_sql(expr: str) -> str:
    out = f"regexp_replace({expr}, '<[^>]+>', '', 'g')"
    for entity, char in _ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char}')"
    return S.collapse(S.fold(out))


@query(
    "title_normalization",
    f"""SELECT page_id, t AS normalized_title, 'title-' || substr(sha256(t), 1, 12) AS family_id
        FROM (SELECT page_id, {_title_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS t FROM pages)""",
)
def title_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = T.normalize_title(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    rows = P.spread(P.table(spark, sf_dir, "pages")).select("page_id", title.alias("normalized_title"))
    return rows.withColumn("family_id", T.title_family(F.col("normalized_title")))


@query("text_previews", f"SELECT doc_id, rtrim(substr({S.collapse('text')}, 1, 700)) AS preview FROM documents")
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(
    "stable_fractions",
    """SELECT doc_id, round(('0x' || substr(sha256('20260810:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE, 12) AS fraction,
       sha256('42:' || source || ':' || doc_id) AS blinded_key FROM documents""",
)
def stable_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select(
        "doc_id", F.round(hashing.stable_fraction(20260810, F.col("doc_id").cast("string")), 12).alias("fraction"),
        hashing.blinded_key(42, F.col("source"), F.col("doc_id").cast("string")).alias("blinded_key"),
    )


@query(
    "recovery_rewrites",
    f"SELECT item_id, {S.strip('text')} || ' {' '.join(T.REWRITE_CONTEXT)}' AS rewritten FROM benchmark",
)
def recovery_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "benchmark").select("item_id", T.rewrite_query(F.col("text")).alias("rewritten"))


# --- catalog, manifest, upsert -----------------------------------------------

_LINE = "string_split(text, chr(10))[1]"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog reply per document, in the three wrapper forms."""
    link = F.concat(F.lit("/files/"), "doc_id", F.lit(".pdf"))
    record = F.struct(
        F.col("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"),
        F.array("lang", "source").alias("keywords"),
        F.array(
            F.struct(
                F.lit("notes.txt").alias("name"), F.lit("text/plain").alias("mimetype"),
                F.struct(F.lit(None).cast("string").alias("pdf"), F.lit("/n").alias("original"), F.concat(F.lit("/t/"), "doc_id").alias("fulltext")).alias("links"),
            ),
            F.struct(
                F.lit("Paper.PDF").alias("name"), F.lit("application/octet-stream").alias("mimetype"),
                F.struct(F.lit(None).cast("string").alias("pdf"), link.alias("original"), F.lit(None).cast("string").alias("fulltext")).alias("links"),
            ),
        ).alias("downloads"),
    )
    total = F.struct(F.col("doc_id").alias("total"))
    body = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.array(record).alias("results"), total.alias("stats"))))
        .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.array(record).alias("citations"), total.alias("stats"))))
        .otherwise(F.to_json(F.array(record)))
    )
    return P.documents(spark, sf_dir).select("doc_id", body.alias("payload"))


@query(
    "catalog_records",
    f"""SELECT doc_id AS document_id, {_LINE} AS title, 'https://catalog.example.org/files/' || doc_id || '.pdf' AS pdf_url,
        'https://catalog.example.org/t/' || doc_id AS fulltext_url, CASE WHEN doc_id % 3 <> 2 THEN doc_id END AS stats_total FROM documents""",
)
def catalog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads(spark, sf_dir)
    totals = rows.withColumn("stats_total", catalog.payload_total(F.col("payload")))
    base = "https://catalog.example.org"
    return catalog.payload_records(totals).select(
        F.col("id").alias("document_id"), "title", catalog.pdf_url(base, F.col("downloads")).alias("pdf_url"),
        catalog.fulltext_url(base, F.col("downloads")).alias("fulltext_url"), "stats_total",
    )


def catalog_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping scans: by language, by source, by label."""
    docs = P.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.element_at(F.split("text", "\n"), 1).alias("first_line")
    )
    labels = P.table(spark, sf_dir, "labels").select("doc_id", "quality")

    def scan(rows: DataFrame, number: int, name, abstract, words) -> DataFrame:
        return rows.select(
            F.col("doc_id").alias("document_id"), F.lit(number).alias("scan_no"), F.col("first_line").alias("title"),
            abstract.alias("abstract"), F.array(*words).alias("keywords"), F.array(name).alias("source_queries"),
        )

    first = scan(
        docs.where("lang <> 'en'"), 1, F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.lit("by language")), [F.col("lang")]
    )
    second = scan(docs, 2, F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.lit("by source")), [F.col("source"), F.col("lang")])
    third = scan(
        docs.join(labels, "doc_id"), 3, F.lit("labelled"), F.lit("by label"),
        [F.concat(F.lit("quality"), "quality"), F.col("source")],
    )
    return first.unionByName(second).unionByName(third)


@query(
    "manifest_merge",
    f"""WITH s AS (
        SELECT doc_id AS document_id, 1 AS scan_no, {_LINE} AS title, CASE WHEN doc_id % 3 = 0 THEN 'by language' END AS abstract, [lang] AS k, lang AS sq FROM documents WHERE lang <> 'en'
        UNION ALL SELECT doc_id, 2, {_LINE}, CASE WHEN doc_id % 2 = 0 THEN 'by source' END, [source, lang], source FROM documents
        UNION ALL SELECT doc_id, 3, {_LINE}, 'by label', ['quality' || quality, source], 'labelled' FROM documents JOIN labels USING (doc_id)),
      kw AS (SELECT document_id, string_agg(DISTINCT x, ',' ORDER BY x) AS keywords FROM (SELECT document_id, unnest(k) AS x FROM s) GROUP BY 1)
      SELECT document_id, arg_min(title, scan_no) AS title, arg_min(abstract, scan_no) FILTER (WHERE abstract IS NOT NULL) AS abstract,
        any_value(keywords) AS keywords, string_agg(DISTINCT sq, ',' ORDER BY sq) AS source_queries
      FROM s JOIN kw USING (document_id) GROUP BY 1""",
)
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = catalog.merge_manifest(catalog_scans(spark, sf_dir), ["title", "abstract"], ["keywords", "source_queries"])
    return merged.select(
        "document_id", "title", "abstract", F.array_join("keywords", ",").alias("keywords"),
        F.array_join("source_queries", ",").alias("source_queries"),
    )


@query(
    "upsert_latest",
    """SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1""",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as two batches of a table keyed by user: the newest version survives."""
    rows = P.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "event_type", "value")
    return index_store.latest_wins(rows.where("version % 3 <> 0"), rows.where("version % 3 = 0"), "user_id", "version")


# --- selection, plans --------------------------------------------------------

_PRIORITY = ["ECONOMY", "PROMO", "STANDARD"]


@query(
    "title_families",
    """WITH p AS (SELECT p_partkey AS document_id, lower(p_name) AS t, p_size AS chunk_count,
         CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 4 END AS tr FROM part),
       r AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, first_value(document_id) OVER (PARTITION BY t ORDER BY chunk_count DESC, tr, document_id) AS rep FROM p)
       SELECT document_id, CASE WHEN n > 1 THEN 'title-' || substr(sha256(t), 1, 12) END AS duplicate_family_id,
         CASE WHEN n > 1 AND rep <> document_id THEN rep END AS representative_document_id, n > 1 AND rep <> document_id AS duplicate_excluded FROM r""",
)
def title_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("document_id"), F.col("p_name").alias("title"), F.col("p_size").alias("chunk_count"),
        F.col("p_type").alias("kind"),
    )
    return selection.title_families(rows, _PRIORITY).select(
        "document_id", "duplicate_family_id", "representative_document_id", "duplicate_excluded"
    )


def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.documents(spark, sf_dir)
    counts = chunking.chunk_receipts(chunking.page_records(docs)).select("document_id", "chunk_count")
    return docs.select(
        F.col("doc_id").alias("document_id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("lang").alias("kind"),
        F.array("source", "lang").alias("source_queries"),
    ).join(counts, "document_id")


_SELECTION = selection.SelectionSettings(60, 2, {"src3": 6, "de": 15, "es": 12, "src7": 4}, ["en", "fr", "de"])
_CANDIDATE_SQL = f"""SELECT doc_id AS document_id, {S.training("regexp_replace(" + _LINE + ", '<[^>]+>', '', 'g')")} AS t, source, lang,
    CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 4 END AS tr,
    CASE WHEN len(w) = 0 THEN 0 ELSE greatest(0, ceil((len(w) - 300) / 240.0))::BIGINT + 1 END AS chunk_count
    FROM (SELECT *, {S.words('text')} AS w FROM documents)"""


def _selection_sql() -> str:
    steps = [
        f"cand AS MATERIALIZED ({_CANDIDATE_SQL})",
        """ranked AS MATERIALIZED (SELECT *, rep <> document_id AS dup FROM (SELECT *, first_value(document_id) OVER (PARTITION BY t ORDER BY chunk_count DESC, tr, document_id) AS rep FROM cand))""",
        "s0 AS MATERIALIZED (SELECT *, NULL::VARCHAR AS reason FROM ranked WHERE NOT dup AND chunk_count >= 2)",
    ]
    for i, (name, minimum) in enumerate(_SELECTION.minimums.items(), start=1):
        steps.append(
            f"""s{i} AS MATERIALIZED (SELECT * EXCLUDE (reason, m, have, turn), CASE WHEN m AND reason IS NULL AND turn <= {minimum} - have THEN 'coverage: {name}' ELSE reason END AS reason FROM (
              SELECT *, count(reason) OVER (PARTITION BY m) AS have, row_number() OVER (PARTITION BY m ORDER BY reason IS NOT NULL, chunk_count DESC, tr, document_id) AS turn
              FROM (SELECT *, source = '{name}' OR lang = '{name}' AS m FROM s{i - 1})))"""
        )
    last = len(_SELECTION.minimums)
    steps.append(
        f"""filled AS (SELECT document_id, CASE WHEN reason IS NULL AND turn <= {_SELECTION.target} - have THEN 'rank fill' ELSE reason END AS reason FROM (
          SELECT *, count(reason) OVER () AS have, row_number() OVER (ORDER BY reason IS NOT NULL, chunk_count DESC, tr, document_id) AS turn FROM s{last}))"""
    )
    return (
        "WITH " + ",\n".join(steps)
        + """ SELECT r.document_id, r.chunk_count, CASE WHEN dup THEN rep END AS representative_document_id,
          CASE WHEN dup THEN 'duplicate_excluded' WHEN f.reason IS NOT NULL THEN 'selected' ELSE 'not_selected' END AS status,
          CASE WHEN dup THEN 'exact-title duplicate' WHEN f.reason IS NOT NULL THEN f.reason WHEN chunk_count < 2 THEN 'below minimum chunks' ELSE 'outside target' END AS reason
        FROM ranked r LEFT JOIN filled f USING (document_id)"""
    )


@query("source_selection", _selection_sql())
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_sources(source_candidates(spark, sf_dir), _SELECTION).select(
        "document_id", "chunk_count", "representative_document_id", "status", "reason"
    )


@query(
    "source_query_counts",
    "SELECT source_query, count(*) AS document_count FROM (SELECT unnest([source, lang]) AS source_query FROM documents) GROUP BY 1",
)
def source_query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.source_query_counts(
        P.table(spark, sf_dir, "documents").select(F.array("source", "lang").alias("source_queries"))
    )


@query(
    "example_plan",
    S.with_steps(
        "chunks",
        """SELECT 'plan_' || printf('%04d', row_number() OVER (ORDER BY document_id, kind_no, start)) AS plan_id, example_type, document_id,
             string_agg(chunk_id, ',' ORDER BY position) AS chunk_ids, sum(word_count)::BIGINT AS evidence_word_count
           FROM wins JOIN num USING (document_id) WHERE position BETWEEN start AND start + size - 1 GROUP BY document_id, kind_no, example_type, start""",
        {
            "num": f"""SELECT document_id, chunk_id, word_count, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS position FROM chunks
                WHERE word_count >= 80 AND NOT starts_with({S.training('text')}, 'references') AND NOT starts_with({S.training('text')}, 'bibliography')""",
            "cnt": "SELECT document_id, count(*) AS n FROM num GROUP BY 1",
            "wins": """SELECT document_id, 0 AS kind_no, 'ordinary' AS example_type, unnest(CASE WHEN n - 2 = 0 THEN [0, 1] ELSE [0, n - 2] END) AS start, 2 AS size FROM cnt WHERE n - 1 >= 2
                UNION ALL SELECT document_id, 1, 'synthesis', (n - 3) // 2, 3 FROM cnt JOIN labels ON doc_id = document_id WHERE quality = 1 AND n >= 3
                UNION ALL SELECT document_id, 2, 'refusal', 2 * (n - 2) // 3, 2 FROM cnt JOIN labels ON doc_id = document_id WHERE toxic = 1 AND n >= 2""",
        },
    ),
)
def example_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = P.table(spark, sf_dir, "labels")
    plan = selection.example_plan(
        P.chunks(spark, sf_dir), labels.where("quality = 1").select(F.col("doc_id").alias("document_id")),
        labels.where("toxic = 1").select(F.col("doc_id").alias("document_id")),
    )
    return plan.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


# --- leakage, duplicates, split ----------------------------------------------

_LINES_SQL = """SELECT doc_id, doc_id || ':' || i AS example_id, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""
_PROTECTED_SQL = """SELECT item_id || ':' || i AS ref, line FROM (
    SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM benchmark)"""


def line_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(F.concat_ws(":", "doc_id", F.col("pos") + 1).alias("example_id"), "doc_id", "line")


@query(
    "leakage_audit",
    f"""WITH e AS ({_LINES_SQL}), p AS ({_PROTECTED_SQL}),
        x AS (SELECT line, min(ref) AS ref FROM p WHERE line <> '' GROUP BY 1),
        n AS (SELECT {S.training('line')} AS line, min(ref) AS ref FROM p WHERE {S.training('line')} <> '' GROUP BY 1),
        q AS (SELECT e.*, x.ref AS xr, n.ref AS nr FROM e LEFT JOIN x ON x.line = e.line LEFT JOIN n ON n.line = {S.training('e.line')}),
        a AS (SELECT e.*, x.ref AS xr, n.ref AS nr FROM e LEFT JOIN x ON x.line = upper(e.line) LEFT JOIN n ON n.line = {S.training('upper(e.line)')} WHERE doc_id % 5 <> 0)
        SELECT 'protected_example_id' AS kind, example_id, example_id AS protected_reference FROM e WHERE example_id IN (SELECT ref FROM p)
        UNION ALL SELECT CASE WHEN xr IS NOT NULL THEN 'exact_query' ELSE 'normalized_query' END, example_id, coalesce(xr, nr) FROM q WHERE coalesce(xr, nr) IS NOT NULL
        UNION ALL SELECT CASE WHEN xr IS NOT NULL THEN 'exact_target_answer' ELSE 'normalized_target_answer' END, example_id, coalesce(xr, nr) FROM a WHERE coalesce(xr, nr) IS NOT NULL
        UNION ALL SELECT 'protected_source_document', example_id, doc_id::VARCHAR FROM e WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document against every line of the benchmark."""
    examples = line_examples(spark, sf_dir).select(
        "example_id", F.col("line").alias("query"), F.upper("line").alias("answer"), (F.col("doc_id") % 5 == 0).alias("refused"),
        F.array("doc_id").alias("document_ids"),
    )
    protected = P.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        F.concat_ws(":", "item_id", F.col("pos") + 1).alias("ref"), "text"
    )
    documents = P.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return leakage.audit(examples, protected, protected, documents)


@query(
    "duplicate_texts",
    f"""SELECT 'exact' AS match, sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_example_id FROM documents GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'normalized', sha256({S.training('text')}), count(*), min(doc_id) FROM documents GROUP BY 2 HAVING count(*) > 1""",
)
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), "text")
    exact = leakage.duplicate_texts(rows, "text", False).withColumn("match", F.lit("exact"))
    return exact.unionByName(leakage.duplicate_texts(rows, "text", True).withColumn("match", F.lit("normalized")))


_COMPONENT_STEPS = {
    "links": "SELECT DISTINCT doc_id AS d, sha256(unnest(string_split(text, chr(10)))) AS l FROM documents",
    "shared": "SELECT d, l FROM links WHERE l IN (SELECT l FROM links GROUP BY 1 HAVING count(*) > 1)",
    "edges": "SELECT DISTINCT a.d AS a, b.d AS b FROM (SELECT l, min(d) AS d FROM shared GROUP BY 1) m JOIN shared a USING (l) JOIN shared b ON b.l = m.l AND (a.d = m.d OR b.d = m.d)",
}
_COMPONENT_SQL = (
    "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({b})" for n, b in _COMPONENT_STEPS.items())
    + """, reach AS (SELECT d AS a, d AS b FROM (SELECT DISTINCT d FROM shared) UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
    comp AS MATERIALIZED (SELECT doc_id AS example_id, 'e' || lpad(coalesce(m, doc_id)::VARCHAR, 19, '0') AS component
      FROM documents LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = doc_id)"""
)


def line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples, their lines as documents."""
    links = P.documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), F.explode(F.split("text", "\n")).alias("line"))
    return links.select("example_id", F.sha2("line", 256).alias("document_id"))


def line_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a line belong together."""
    return split.example_components(line_links(spark, sf_dir))


@query("split_components", f"{_COMPONENT_SQL} SELECT example_id, component FROM comp")
def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(spark, sf_dir)


@query(
    "train_dev_split",
    f"""{_COMPONENT_SQL}, keys AS (SELECT component, string_agg(DISTINCT l, ',' ORDER BY l) AS key FROM comp JOIN links ON d = example_id GROUP BY 1),
        sizes AS (SELECT component, key, count(*) AS n, ('0x' || substr(sha256('20260810:' || key), 1, 16))::UBIGINT::DOUBLE AS f FROM comp JOIN keys USING (component) GROUP BY 1, 2),
        placed AS (SELECT *, sum(n) OVER (ORDER BY f, key) AS c, row_number() OVER (ORDER BY f, key) AS p, count(*) OVER () AS k, sum(n) OVER () AS total FROM sizes),
        best AS (SELECT p FROM placed WHERE p < k ORDER BY abs(c - greatest(1, least(total - 1, round_even(total * 0.1, 0)))), p LIMIT 1)
        SELECT example_id, component, CASE WHEN p <= (SELECT p FROM best) THEN 'dev' ELSE 'train' END AS side FROM comp JOIN placed USING (component)""",
)
def train_dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = line_links(spark, sf_dir)
    members = stored(split.example_components(links))
    return split.split(members, 0.1, 20260810, split.document_order(links, members, 20260810))


@query(
    "protected_overlap",
    "SELECT doc_id AS document_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE contains(text, 'Licensed under')",
)
def protected_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = P.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    right = P.documents(spark, sf_dir).where(F.contains("text", F.lit("Licensed under"))).select(F.col("doc_id").alias("document_id"))
    return leakage.shared_documents(left, right)


# --- integrity ---------------------------------------------------------------


@query(
    "integrity_violations",
    """SELECT check_name, count(*) AS violations FROM (
         SELECT 'text_length' AS check_name FROM documents WHERE n_chars <> length(text)
         UNION ALL SELECT 'text_reused' FROM (SELECT 1 FROM documents GROUP BY sha256(text) HAVING count(*) > 1)
         UNION ALL SELECT 'unlabelled_document' FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
         UNION ALL SELECT 'unknown_order' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
         UNION ALL SELECT 'mixed_customer_status' FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus))
         UNION ALL SELECT 'vector_dimension' FROM embeddings WHERE len(embedding) <> 64
         UNION ALL SELECT 'negative_balance' FROM customer WHERE c_acctbal < 0
         UNION ALL SELECT 'total_differs' FROM (SELECT c_custkey FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey)) GROUP BY 1""",
)
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def t(name: str) -> DataFrame:
        return P.table(spark, sf_dir, name)

    docs = t("documents")
    nations = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    homes = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return integrity.summary(
        integrity.all_of(
            integrity.rows_where(docs, "text_length", "doc_id", F.col("n_chars") != F.length("text")),
            integrity.duplicate_keys(docs.select(F.sha2("text", 256).alias("digest")), "text_reused", ["digest"]),
            integrity.orphans(docs, t("labels"), "unlabelled_document", "doc_id", "doc_id"),
            integrity.orphans(t("lineitem"), t("orders"), "unknown_order", "l_orderkey", "o_orderkey"),
            integrity.varying_within(t("orders"), "mixed_customer_status", "o_custkey", ["o_orderstatus"]),
            integrity.rows_where(t("embeddings"), "vector_dimension", "vec_id", F.size("embedding") != 64),
            integrity.rows_where(t("customer"), "negative_balance", "c_custkey", F.col("c_acctbal") < 0),
            integrity.differing_columns(nations, homes, "total_differs", "k", ["nation"]),
        )
    )


@query(
    "index_mismatch",
    "SELECT doc_id AS chunk_id, 'no_vector' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'no_chunk' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
)
def index_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_store.index_mismatch(
        P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")),
        P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")),
    )


@query(
    "table_counts",
    "SELECT source, count(*) AS chunk_count FROM documents GROUP BY GROUPING SETS ((source), ())",
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored row counts, per source and overall in one pass."""
    docs = P.table(spark, sf_dir, "documents")
    return docs.groupingSets([[F.col("source")], []], F.col("source")).agg(F.count("*").alias("chunk_count"))


# --- record tables -----------------------------------------------------------

_RECEIPT_SQL = """SELECT event_id AS plan_id, ['ordinary', 'synthesis', 'refusal'][1 + event_id % 3] AS example_type,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'rejected' ELSE 'accepted' END AS status,
    k % 3 AS qa, k % 4 AS va, k % 5 AS aa, 100 + k AS it, 10 + k AS ot, value / 1000 AS cost, k % 10 <> 0 AS complete
    FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""


def plan_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kinds = F.array(*[F.lit(t) for t in record_tables.EXAMPLE_TYPES])
    kind = F.col("event_type")
    return P.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("plan_id"), F.element_at(kinds, (1 + F.col("event_id") % 3).cast("int")).alias("example_type"),
        F.when(kind == "error", "failed").when(kind == "view", "rejected").otherwise("accepted").alias("status"),
        (k % 3).alias("question_attempts"), (k % 4).alias("verification_attempts"), (k % 5).alias("answer_attempts"),
        (100 + k).alias("input_tokens"), (10 + k).alias("output_tokens"), (110 + 2 * k).alias("total_tokens"),
        (F.col("value") / 1000).alias("estimated_cost_usd"), (k % 10 != 0).alias("telemetry_complete"),
    )


@query(
    "receipt_summary",
    f"""WITH r AS ({_RECEIPT_SQL}) SELECT count(*) AS record_count, count(*) FILTER (WHERE status = 'accepted') AS accepted_count,
        count(*) FILTER (WHERE status = 'rejected') AS rejected_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
        {', '.join(f"count(*) FILTER (WHERE status = 'accepted' AND example_type = '{t}') AS {t}_accepted_count" for t in ('ordinary', 'synthesis', 'refusal'))},
        sum(qa)::BIGINT AS total_question_attempts, sum(va)::BIGINT AS total_verification_attempts, sum(aa)::BIGINT AS total_answer_attempts,
        sum(it)::BIGINT AS total_input_tokens, sum(ot)::BIGINT AS total_output_tokens, sum(it + ot)::BIGINT AS total_tokens,
        round(sum(cost), 6) AS total_estimated_cost_usd, bool_and(complete) AS telemetry_complete FROM r""",
)
def receipt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_tables.receipt_summary(plan_receipts(spark, sf_dir))


@query(
    "pending_plans",
    f"WITH r AS ({_RECEIPT_SQL}) SELECT o_orderkey AS plan_id FROM orders WHERE o_orderkey NOT IN (SELECT plan_id FROM r WHERE status = 'accepted')",
)
def pending_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"))
    return record_tables.pending_plans(plans, plan_receipts(spark, sf_dir))


# Visual assets: every link of a raw page is one asset of that page.
_ASSET_SQL = """SELECT page_id, 'link' AS asset_type, i AS asset_index, h AS caption_text, page_id || ':link:' || printf('%03d', i) AS asset_id
    FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages)"""


def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = P.spread(P.table(spark, sf_dir, "pages")).select("page_id", F.posexplode_outer(links).alias("pos", "caption_text"))
    return rows.where("pos IS NOT NULL").select(
        "page_id", F.lit("link").alias("asset_type"), (F.col("pos") + 1).alias("asset_index"), "caption_text",
        record_tables.visual_asset_id(F.col("page_id").cast("string"), F.lit("link"), F.col("pos") + 1).alias("asset_id"),
    )


@query(
    "annotation_tasks",
    f"WITH a AS ({_ASSET_SQL}) SELECT asset_id || ':annotation:v0.1' AS task_id, 'v0.1' AS task_version, * FROM a",
)
def annotation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_tables.annotation_tasks(page_assets(spark, sf_dir), "v0.1")


@query(
    "page_representatives",
    f"WITH a AS ({_ASSET_SQL}) SELECT page_id, asset_type, asset_index, caption_text, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY asset_type, asset_index) AS r FROM a) WHERE r = 1",
)
def page_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_tables.page_representatives(page_assets(spark, sf_dir))
