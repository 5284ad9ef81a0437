"""Reusable SQL fragments for the check queries.

``with_steps("bm25", "SELECT ...")`` puts every step the named one needs in
front of the final statement, in order.
"""

from __future__ import annotations

import re

from citeweave.functions import text as T

LEX = T.LEXICAL_TOKEN.replace("'", "''")


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{T.BLANK_RUN}'), lambda w: w <> '')"


def lexical(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{LEX}')"


def fold(expr: str) -> str:
    single = f"translate({expr}, '{T.FOLD_FROM}', '{T.FOLD_TO}')"
    lengths = " ".join(f"WHEN '{c}' THEN '{f}'" for c, f in T.FOLD_LONG.items())
    expanded = f"array_to_string(list_transform(string_split({single}, ''), lambda c: CASE c {lengths} ELSE c END), '')"
    return (
        f"CASE WHEN NOT regexp_matches({expr}, '[^\\x00-\\x7f]') THEN lower({expr}) "
        f"WHEN regexp_matches({expr}, '[{''.join(T.FOLD_LONG)}]') THEN {expanded} ELSE {single} END"
    )


def strip(expr: str) -> str:
    return f"trim({expr}, '{T.BLANKS}')"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{T.BLANK_RUN}', ' ', 'g'))"


def training(expr: str) -> str:
    return collapse(fold(expr))


def semantic(expr: str) -> str:
    return f"trim(regexp_replace({fold(expr)}, '[^a-z0-9]+', ' ', 'g'))"


def literal_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def stem(t: str) -> str:
    aliases = " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in T.TOKEN_ALIASES.items())
    return (
        f"CASE {aliases} WHEN regexp_matches({t}, '^[0-9]+$') THEN {t} "
        f"WHEN length({t}) > 5 AND suffix({t}, 'ies') THEN substr({t}, 1, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 5 AND suffix({t}, 'ing') THEN substr({t}, 1, length({t}) - 3) "
        f"WHEN length({t}) > 4 AND suffix({t}, 'ed') THEN substr({t}, 1, length({t}) - 2) "
        f"WHEN length({t}) > 4 AND suffix({t}, 's') AND NOT suffix({t}, 'ss') THEN substr({t}, 1, length({t}) - 1) "
        f"ELSE {t} END"
    )


def stemmed(expr: str) -> str:
    return f"list_transform(regexp_extract_all({fold(expr)}, '{T.SIMPLE_TOKEN}'), lambda t: {stem('t')})"


def not_stop(t: str) -> str:
    return f"{t} NOT IN ({literal_list(T.STOP_WORDS)})"


def informative(expr: str) -> str:
    return (
        f"list_distinct(list_filter({stemmed(expr)}, "
        f"lambda t: {not_stop('t')} AND NOT regexp_matches(t, '^[a-z]$')))"
    )


def scopes(expr: str) -> str:
    """Marker plus the next two non-stop tokens, for every marker."""
    kept = f"list_filter({stemmed(expr)}, lambda t: {not_stop('t')})"
    return (
        f"list_distinct(list_filter(list_transform({kept}, lambda t, i: CASE WHEN t IN ({literal_list(T.SCOPE_MARKERS)}) "
        f"THEN array_to_string(list_slice({kept}, i, i + 2), '_') END), lambda p: p IS NOT NULL))"
    )


def claims(expr: str) -> str:
    cases = " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in T.CLAIM_QUALIFIERS.items())
    return (
        f"list_distinct(list_filter(list_transform(regexp_extract_all({fold(expr)}, '{T.SIMPLE_TOKEN}'), "
        f"lambda t: CASE {cases} END), lambda p: p IS NOT NULL))"
    )


def numbers(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({expr}, '{T.SIMPLE_TOKEN}'), lambda t: regexp_matches(t, '^[0-9]+$')))"


def anchors(expr: str) -> str:
    pieces = (
        f"list_filter(list_transform(regexp_extract_all(t, '{T.SIMPLE_TOKEN}'), lambda p: {stem('lower(p)')}), "
        "lambda p: length(p) >= 2)"
    )
    named = (
        "CASE WHEN contains(t, '-') THEN regexp_matches(t, '^.+[A-Z]') OR regexp_matches(t, '[0-9]') "
        "ELSE regexp_matches(t, '^.+[A-Z]') END"
    )
    return (
        f"list_distinct(flatten(list_transform(regexp_extract_all({expr}, '{T.HYPHENATED_TOKEN}'), lambda t: "
        f"CASE WHEN regexp_matches(t, '^[A-Z]{{2,}}$') THEN [{stem('lower(t)')}] WHEN {named} THEN {pieces} "
        "ELSE []::VARCHAR[] END)))"
    )


STEPS: dict[str, tuple[list[str], str]] = {
    "docw": (
        [],
        f"SELECT doc_id, source, sha256(text) AS sha, {words('text')} AS w FROM documents",
    ),
    "chunks": (
        ["docw"],
        """SELECT doc_id || ':chunk:' || printf('%05d', i) AS chunk_id, doc_id AS document_id, i AS chunk_index,
             array_to_string(list_slice(w, i * 240 + 1, i * 240 + 300), ' ') AS text,
             len(list_slice(w, i * 240 + 1, i * 240 + 300)) AS word_count, source AS source_url, sha
           FROM (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 0
                   ELSE greatest(0, ceil((len(w) - 300) / 240.0))::BIGINT + 1 END)) AS i FROM docw)""",
    ),
    "lines": (
        [],
        f"""SELECT doc_id, page_number, n, sum(n) OVER (PARTITION BY doc_id ORDER BY page_number) AS e
           FROM (SELECT doc_id, page_number, len({words('raw')}) AS n FROM
             (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                     generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM documents))
           WHERE n > 0""",
    ),
    "chunk_pages": (
        ["chunks", "lines"],
        """SELECT c.chunk_id, min(l.page_number) AS page_start, max(l.page_number) AS page_end, count(*) AS n_pages
           FROM chunks c JOIN lines l ON l.doc_id = c.document_id AND l.e > c.chunk_index * 240
             AND l.e - l.n < c.chunk_index * 240 + c.word_count
           GROUP BY 1""",
    ),
    "q": ([], "SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark"),
    "tok": (["chunks"], f"SELECT chunk_id, unnest({lexical('text')}) AS term FROM chunks"),
    "tf": (["tok"], "SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL"),
    "dl": (["tok"], "SELECT chunk_id, count(*) AS dl FROM tok GROUP BY 1"),
    "corpus": (
        ["tok", "chunks"],
        "SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM chunks) AS avgdl",
    ),
    "dfreq": (["tf"], "SELECT term, count(*) AS df FROM tf GROUP BY 1"),
    "qterm": (["q"], f"SELECT DISTINCT query_id, unnest({lexical('query')}) AS term FROM q"),
    "bm25": (
        ["qterm", "tf", "dl", "dfreq", "corpus"],
        """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
             SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
               / (tf + 1.5 * (0.25 + 0.75 * (dl / avgdl)))), 8) AS score
             FROM qterm JOIN tf USING (term) JOIN dl USING (chunk_id) JOIN dfreq USING (term), corpus
             GROUP BY 1, 2) WHERE score > 0""",
    ),
    "chunkvec": (
        ["chunks"],
        f"""SELECT chunk_id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)) AS x FROM (
             SELECT chunk_id, ('0x' || substr(sha256(w), 1, 8))::UBIGINT % 64 AS slot, count(*)::DOUBLE AS c
             FROM (SELECT chunk_id, unnest({words('lower(text)')}) AS w FROM chunks) GROUP BY 1, 2)""",
    ),
    "queryvec": (
        ["q"],
        f"""SELECT query_id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS x FROM (
             SELECT query_id, ('0x' || substr(sha256(w), 1, 8))::UBIGINT % 64 AS slot, count(*)::DOUBLE AS c
             FROM (SELECT query_id, unnest({words('lower(query)')}) AS w FROM q) GROUP BY 1, 2)""",
    ),
    "dense": (
        ["chunkvec", "queryvec"],
        """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
             SELECT query_id, chunk_id, round(greatest(-1, least(1, coalesce(sum(q.x * c.x), 0))), 8) AS score
             FROM queryvec q JOIN chunkvec c USING (slot) GROUP BY 1, 2)""",
    ),
    "rrf": (
        ["bm25", "dense"],
        """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM (
             SELECT query_id, chunk_id, b.rank AS bm25_rank, b.score AS bm25_score, d.rank AS dense_rank,
               d.score AS dense_score, least(b.rank, d.rank) AS best_rank,
               round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 12) AS score
             FROM (SELECT * FROM bm25 WHERE rank <= 50) b
             FULL JOIN (SELECT * FROM dense WHERE rank <= 50) d USING (query_id, chunk_id))""",
    ),
    "rerank": (
        ["rrf", "qterm", "tf"],
        """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hybrid_rank, chunk_id) AS rank FROM (
             SELECT r.query_id, r.chunk_id, r.rank AS hybrid_rank, r.score AS hybrid_score, bm25_rank, dense_rank,
               round(count(tf.term) / count(t.term), 6) AS score
             FROM (SELECT * FROM rrf WHERE rank <= 20) r JOIN qterm t ON t.query_id = r.query_id
             LEFT JOIN tf ON tf.chunk_id = r.chunk_id AND tf.term = t.term
             GROUP BY ALL)""",
    ),
    "qrels": (
        ["chunks", "q"],
        f"""SELECT DISTINCT query_id, chunk_id FROM
             (SELECT query_id, unnest(list_transform(range(1, greatest(len(t) - 6, 1)), lambda i: array_to_string(list_slice(t, i, i + 7), ' '))) AS s
              FROM (SELECT query_id, string_split({semantic('query')}, ' ') AS t FROM q))
           JOIN (SELECT chunk_id, unnest(list_transform(range(1, greatest(len(t) - 6, 1)), lambda i: array_to_string(list_slice(t, i, i + 7), ' '))) AS s
              FROM (SELECT chunk_id, string_split({semantic('text')}, ' ') AS t FROM chunks)) USING (s)""",
    ),
    # Evidence fold: the remaining budget depends on the kept length so far.
    "fold": (
        ["rerank", "chunks", "q"],
        f"""SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS items, '' AS text, '' AS chunk_id FROM q
           UNION ALL
           SELECT f.query_id, h.rank, f.used + length(h.cut), f.items + (h.cut <> '')::INT, h.cut, h.chunk_id
           FROM fold f, LATERAL (
             SELECT r.rank, r.chunk_id, {strip('substr(c.text, 1, greatest(0, least(3000, 12000 - f.used)))')} AS cut
             FROM rerank r JOIN chunks c USING (chunk_id)
             WHERE r.query_id = f.query_id AND r.rank = f.rank + 1 AND r.rank <= 5) h""",
    ),
    "evidence": (
        ["fold"],
        "SELECT query_id, 'E' || items AS evidence_id, items AS pos, rank, chunk_id, text FROM fold WHERE text <> ''",
    ),
}


def steps_for(*names: str) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in STEPS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def retagged(names: list[str], tag: str) -> dict[str, str]:
    """Copies of steps that read each other under tagged names."""
    pattern = re.compile(r"\b(" + "|".join(sorted([*names, "q"], key=len, reverse=True)) + r")\b")
    return {f"{n}{tag}": pattern.sub(lambda m: m.group(1) + tag, STEPS[n][1]) for n in names}


def with_steps(names: str | list[str], final: str, extra: dict[str, str] | None = None) -> str:
    """Full statement: all needed steps, then ``extra`` steps, then ``final``."""
    wanted = [names] if isinstance(names, str) else names
    parts = []
    for name in steps_for(*wanted):
        kind = "" if name == "fold" else "MATERIALIZED "
        parts.append(f"{name} AS {kind}({STEPS[name][1]})")
    for name, body in (extra or {}).items():
        kind = "" if name.startswith("fold") else "MATERIALIZED "
        parts.append(f"{name} AS {kind}({body})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final
