"""Column-to-column text functions: tokenizers, normalizers, stems, previews.

Everything here stays inside the JVM. Patterns are limited to constructs that
Java, Python and RE2 read the same way.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that have to agree with the published behaviour ---------------
# (token patterns, the two-facet question form, word lists and alias tables)
LEXICAL_TOKEN = "[a-z0-9]+(?:[-'][a-z0-9]+)*"
SIMPLE_TOKEN = "[A-Za-z0-9]+"
HYPHENATED_TOKEN = "[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
SHARED_BY = r"(?i)^\s*(?:what\s+)?(.+?)\s+are\s+shared\s+by\s+(.+?)\s+and\s+(.+?)[?.!]*\s*$"

REWRITE_CONTEXT = ("NASA", "aerospace", "technical", "report")

STOP_WORDS = [
    "a", "an", "and", "are", "aboard", "as", "at", "be", "been", "being", "between", "by", "can", "did",
    "do", "does", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their",
    "this", "technically", "to", "was", "were", "what", "when", "where", "which", "who", "why", "with",
]

TOKEN_ALIASES = {
    "batteries": "battery", "cells": "cell", "cooled": "cool", "cooling": "cool", "detected": "detect",
    "detecting": "detect", "detection": "detect", "fires": "fire", "challenging": "challenge",
    "issued": "issue", "mandated": "mandate", "assigned": "assign", "stored": "storage",
    "stores": "storage", "storing": "storage", "propagated": "propagate", "propagates": "propagate",
    "propagation": "propagate",
}

CLAIM_QUALIFIERS = {
    "assign": "assign", "assigned": "assign", "assigns": "assign", "certified": "certify",
    "certifies": "certify", "certify": "certify", "every": "every", "issued": "issue", "legal": "legal",
    "legally": "legal", "mandate": "mandate", "mandated": "mandate", "mandates": "mandate",
    "official": "official", "officially": "official", "require": "require", "required": "require",
    "requires": "require", "universal": "universal", "universally": "universal", "worldwide": "worldwide",
}

SCOPE_MARKERS = [
    "all", "every", "guarantee", "permanent", "permanently", "universal", "universally", "worldwide", "zero",
]

GENERIC_FACET_TERMS = ["a", "an", "and", "aircraft", "aircrafts", "system", "systems", "propulsion", "the"]
# ---------------------------------------------------------------------------

# Derived from the standard library's Unicode tables; no code point beyond plane 1 is a blank or has case.
_LETTERS = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
BLANKS = "".join(c for c in _LETTERS if c.isspace())
BLANK_RUN = f"[{BLANKS}]+"
# Java tests single letters up to Latin-1 by one table; ranges and later letters cost a comparison each.
ASCII_WORD = "[^\\x09\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x1f\\x20]+"
LATIN_WORD = f"{ASCII_WORD[:-2]}\\x85\\xa0]+"
WORD = f"[^{BLANKS}]+"
_FOLDED = {c: c.casefold() for c in _LETTERS if c.casefold() != c}
FOLD_FROM = "".join(c for c, f in _FOLDED.items() if len(f) == 1)
FOLD_TO = "".join(f for f in _FOLDED.values() if len(f) == 1)
FOLD_LONG = {c: f for c, f in _FOLDED.items() if len(f) > 1}
del _LETTERS


def _literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _is_latin(text: Column) -> Column:
    return ~text.rlike("[^\\x00-\\xff]")


def fold_case(text: Column) -> Column:
    """Unicode case folding: single letters by one translation, the others ("ß" to "ss") letter by letter.

    ASCII and Latin-1 texts, nearly all in practice, need neither: lower case folds all their letters but two.
    """
    latin = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    single = F.translate(text, FOLD_FROM, FOLD_TO)
    expanded = F.array_join(
        F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(_literal_map(FOLD_LONG), c), c)), ""
    )
    return (
        F.when(_is_ascii(text), F.lower(text))
        .when(_is_latin(text), latin)
        .when(text.rlike(f"[{''.join(FOLD_LONG)}]"), expanded)
        .otherwise(single)
    )


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Collapse runs of Unicode blanks to one blank and trim both ends."""
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


def words(text: Column) -> Column:
    """Words between Unicode blanks, without empties."""
    ascii_words, latin_words, all_words = (
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for pattern in (ASCII_WORD, LATIN_WORD, WORD)
    )
    return F.when(_is_ascii(text), ascii_words).when(_is_latin(text), latin_words).otherwise(all_words)


def lexical_tokens(text: Column) -> Column:
    """Tokens for lexical ranking; inner hyphens and apostrophes are kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL_TOKEN), F.lit(0))


def simple_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SIMPLE_TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(simple_tokens(F.lower(text)))


def stem(token: Column) -> Column:
    """Alias first, digits unchanged, then -ies/-ing/-ed/-s in that order."""
    size = F.length(token)
    stemmed = (
        F.when(token.rlike("^[0-9]+$"), token)
        .when((size > 5) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), size - 3), F.lit("y")))
        .when((size > 5) & token.endswith("ing"), F.substring(token, F.lit(1), size - 3))
        .when((size > 4) & token.endswith("ed"), F.substring(token, F.lit(1), size - 2))
        .when((size > 4) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), size - 1))
        .otherwise(token)
    )
    aliased = F.try_element_at(_literal_map(TOKEN_ALIASES), token)
    return F.coalesce(aliased, stemmed)


def stemmed_tokens(text: Column) -> Column:
    return F.transform(simple_tokens(fold_case(text)), stem)


def distinct_stems(text: Column) -> Column:
    """Stems in order of their first token; every distinct token is stemmed once."""
    return F.array_distinct(F.transform(F.array_distinct(simple_tokens(fold_case(text))), stem))


def informative_terms(query: Column) -> Column:
    """Ordered distinct stems without stop words and single letters."""
    stop = _literal_array(STOP_WORDS)
    kept = F.filter(
        stemmed_tokens(query), lambda t: ~F.array_contains(stop, t) & ~t.rlike("^[a-z]$")
    )
    return F.array_distinct(kept)


def numeric_terms(query: Column) -> Column:
    return F.array_distinct(F.filter(simple_tokens(query), lambda t: t.rlike("^[0-9]+$")))


def named_anchors(query: Column) -> Column:
    """Acronyms plus mixed-case or hyphen-digit names, split and stemmed."""

    def parts(token: Column) -> Column:
        acronym = token.rlike("^[A-Z]{2,}$")
        inner_upper = token.rlike("^.+[A-Z]")
        has_digit = token.rlike("[0-9]")
        named = F.when(F.instr(token, "-") > 0, inner_upper | has_digit).otherwise(inner_upper)
        pieces = F.filter(
            F.transform(simple_tokens(token), lambda p: stem(F.lower(p))), lambda p: F.length(p) >= 2
        )
        return (
            F.when(acronym, F.array(stem(F.lower(token))))
            .when(named, pieces)
            .otherwise(F.array().cast("array<string>"))
        )

    tokens = F.regexp_extract_all(query, F.lit(HYPHENATED_TOKEN), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(tokens, parts)))


def claim_qualifiers(query: Column) -> Column:
    mapping = _literal_map(CLAIM_QUALIFIERS)
    mapped = F.transform(simple_tokens(fold_case(query)), lambda t: F.try_element_at(mapping, t))
    return F.array_distinct(F.filter(mapped, lambda q: q.isNotNull()))


def scope_qualifiers(text: Column) -> Column:
    """Absolute-claim marker joined with the next two non-stop tokens.

    Stop words are removed once, so the follow-up tokens of a marker are simply
    the next two positions (no marker is itself a stop word).
    """
    stop = _literal_array(STOP_WORDS)
    markers = _literal_array(SCOPE_MARKERS)
    kept = F.filter(stemmed_tokens(text), lambda t: ~F.array_contains(stop, t))
    phrases = F.transform(
        kept,
        lambda t, i: F.when(F.array_contains(markers, t), F.array_join(F.slice(kept, i + 1, 3), "_")),
    )
    return F.array_distinct(F.filter(phrases, lambda p: p.isNotNull()))


def normalize_page_text(text: Column) -> Column:
    """Clean extracted page text while keeping paragraph boundaries."""
    unified = F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), "\r\n|\r", "\n")
    lines = F.transform(F.split(unified, "\n"), lambda l: F.trim(F.regexp_replace(l, "[ \t]+", " ")))
    squeezed = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(squeezed, "^\n+|\n+$", "")


def normalize_training_text(text: Column) -> Column:
    return collapse(fold_case(text))


def normalize_semantic_text(text: Column) -> Column:
    """Casefold, turn every non-alphanumeric run into a blank, trim."""
    return F.trim(F.regexp_replace(fold_case(text), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Character references to text; the entity table is the standard library's."""
    return texts.map(html.unescape, na_action="ignore")


def normalize_title(title: Column) -> Column:
    """Strip tags, decode entities, casefold, collapse whitespace.

    Only titles with an ampersand carry a text into the Python worker.
    """
    bare = F.regexp_replace(title, "<[^>]+>", "")
    coded = F.when(F.contains(bare, F.lit("&")), bare)
    decoded = F.coalesce(decode_entities(coded), bare)
    return collapse(fold_case(decoded))


def title_family(normalized_title: Column) -> Column:
    return F.concat(F.lit("title-"), F.substring(F.sha2(normalized_title, 256), 1, 12))


def preview(text: Column, max_characters: int = 700) -> Column:
    return F.rtrim(F.substring(collapse(text), 1, max_characters))


def extract_statement(text: Column, maximum_characters: int = 420) -> Column:
    """Bounded extractive statement ending at a sentence, else a word boundary."""
    whole = collapse(text)
    head = F.substring(whole, 1, maximum_characters)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    word_cut = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    return (
        F.when(F.length(whole) <= maximum_characters, whole)
        .when(sentence != "", F.trim(sentence))
        .when(word_cut != "", F.concat(F.rtrim(word_cut), F.lit("…")))
        .otherwise(F.concat(F.rtrim(head), F.lit("…")))
    )


def facet_terms(text: Column) -> Column:
    return F.array_distinct(
        F.array_except(simple_tokens(fold_case(text)), _literal_array(GENERIC_FACET_TERMS))
    )


def contains_all_terms(tokens: Column, required: Column) -> Column:
    return F.size(F.array_except(required, tokens)) == 0


def rewrite_query(query: Column, context: tuple[str, ...] = REWRITE_CONTEXT) -> Column:
    """Recovery rewrite: the question followed by fixed context terms."""
    return F.concat_ws(" ", strip(query), F.lit(" ".join(context)))


def trimmed_distinct(values: Column) -> Column:
    """Null becomes empty; trim, drop blanks, keep first occurrences."""
    filled = F.coalesce(values, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(filled, strip), lambda v: v != ""))


def optional_text(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(fallback))


def strip_code_fence(text: Column) -> Column:
    """Body of a Markdown code fence, or the trimmed text itself."""
    body = F.regexp_extract(strip(text), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", 1)
    return F.coalesce(F.nullif(body, F.lit("")), strip(text))
