"""Secret scans with a trigram inverted index.

Each rule is a regular expression. Its syntax tree gives a Boolean query over trigrams that every
match must contain: a literal run needs all its trigrams, alternatives are joined by OR, parts by
AND, and what can be anything needs nothing. A segment of texts (about two megabytes) is indexed:
trigram -> sorted row numbers, for the trigrams that some rule asks for. The query intersects and
unites those postings; only candidate rows are searched with the expression. A rule without a
mandatory trigram (long hexadecimal runs) is searched in every text. Trigrams are bytes of the
ASCII-lower-cased text, so expressions may ignore case.

Segments belong to one task, so the scan needs no shuffle and no group can grow hot. ``index``
gives the same postings as rows for inspection.

Defined results: null and empty texts have no finding; spans are code points with exclusive end;
matches of one rule are leftmost and do not overlap; a match whose measured part is shorter than
the rule's minimum is dropped. Repeated rows give repeated findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import ddl
from citeweave.llm.textops import LOWER, slices

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # older interpreters
    import sre_constants as C
    import sre_parse as P


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters of the measured group
    group: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


# The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
# Published formats of other credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_api", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("payment", r"sk_live_[A-Za-z0-9]+", 24),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
RULES = BASE_RULES + MORE_RULES
MAX_STRINGS = 64

# A query is True (anything), a trigram, or ("and"/"or", frozenset of queries).


def _join(word: str, parts: list) -> object:
    if word == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat: set = set()
    for part in parts:
        flat |= part[1] if isinstance(part, tuple) and part[0] == word else {part}
    return next(iter(flat)) if len(flat) == 1 else (word, frozenset(flat))


def _need(strings: frozenset[str]) -> object:
    """Query for texts that contain one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return True
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op, arg) -> frozenset[str] | None:
    """All (lower-cased) strings a single-character node can match; None if too many."""
    if op is C.LITERAL:
        return frozenset({chr(arg).lower()}) if arg < 128 else None
    if op is C.IN and not any(k is C.NEGATE or k is C.CATEGORY for k, _ in arg):
        found: set[str] = set()
        for k, v in arg:
            points = [v] if k is C.LITERAL else range(v[0], v[1] + 1)
            if len(points) > 16 or any(p >= 128 for p in points):
                return None
            found |= {chr(p).lower() for p in points}
        return frozenset(found)
    return None


def _analyse(nodes) -> tuple[frozenset[str] | None, object]:
    """(all strings the nodes match, or None; query that every match satisfies)."""
    runs: list[frozenset[str]] = [frozenset({""})]
    needs: list = []
    exact = True

    def cut() -> None:
        nonlocal exact
        needs.append(_need(runs[-1]))
        runs.append(frozenset({""}))
        exact = False

    for op, arg in nodes:
        strings, need = _strings(op, arg), True
        if op is C.SUBPATTERN:
            strings, need = _analyse(arg[3])
        elif op is C.BRANCH:
            parts = [_analyse(branch) for branch in arg[1]]
            need = _join("or", [q for _, q in parts])
            strings = None if any(s is None for s, _ in parts) else reduce(frozenset.union, [s for s, _ in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            inside, need = _analyse(inner)
            if inside is not None and high <= 3:
                strings, power = frozenset(), frozenset({""})
                for times in range(high + 1):
                    strings |= power if times >= low else frozenset()
                    power = frozenset(a + b for a in power for b in inside)
            need = need if low > 0 else True
        elif op is C.AT:
            continue
        needs.append(need)
        if strings is not None and len(runs[-1]) * len(strings) <= MAX_STRINGS:
            runs[-1] = frozenset(a + b for a in runs[-1] for b in strings)
        else:
            cut()
            if strings is not None and len(strings) <= MAX_STRINGS:
                runs[-1] = strings
    whole = runs[-1] if exact else None
    needs.append(_need(runs[-1]))
    return whole, _join("and", needs)


def trigram_query(pattern: str) -> object:
    """Boolean trigram query of a regular expression; True if nothing is mandatory."""
    return _analyse(P.parse(pattern, re.ASCII))[1]


def _trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[_trigrams(q) for q in query[1]])


class Scanner:
    """Rules with their queries and the table of trigrams that the queries use."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.expressions = [r.compiled() for r in rules]
        self.names = sorted(set().union(*[_trigrams(q) for q in self.queries]))
        self.lookup = np.full(1 << 24, -1, np.int16)
        for i, name in enumerate(self.names):
            a, b, c = name.encode()
            self.lookup[a << 16 | b << 8 | c] = i

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Sorted rows of the segment for each trigram of the queries."""
        if len(data) < 3 or not self.names:
            return {}
        low = LOWER[data].astype(np.int32)
        found = self.lookup[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(found >= 0)
        rows = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[rows + 1]
        pairs = np.unique(found[at][inside].astype(np.int64) * len(offsets) + rows[inside])
        which, rows = pairs // len(offsets), pairs % len(offsets)
        return {self.names[t]: rows[which == t] for t in np.unique(which)}

    def candidates(self, query: object, postings: dict[str, np.ndarray], rows: int) -> np.ndarray:
        if query is True:
            return np.arange(rows)
        if isinstance(query, str):
            return postings.get(query, np.zeros(0, np.int64))
        parts = sorted((self.candidates(q, postings, rows) for q in query[1]), key=len)
        unite = np.union1d if query[0] == "or" else lambda a, b: np.intersect1d(a, b, assume_unique=True)
        return reduce(unite, parts)

    def findings(self, texts: list[str | None], rows: dict[int, list[int]]) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule number) per text, by start and then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, rule in enumerate(self.rules):
            search = self.expressions[number].finditer
            for row in rows[number]:
                for match in search(texts[row] or ""):
                    start, end = match.span(rule.group)
                    if end - start >= rule.least:
                        out[row].append((match.start(), match.end(), number))
        for found in out:
            if len(found) > 1:
                found.sort(key=lambda f: (f[0], f[2]))
        return out


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index as rows (trigram, key): one row per text and trigram that some rule asks for."""
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for start, _, data, offsets in slices(batch.column(1)):
                for name, rows in scanner.postings(data, offsets).items():
                    keys = batch.column(0).take(pa.array(rows + start))
                    yield pa.record_batch([pa.array([name] * len(rows)), keys], ["trigram", "key"])

    return kept.mapInArrow(build, f"trigram string, key {kept.schema['key'].dataType.simpleString()}")


def _found(scanner: Scanner, column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Findings of every text of a batch, segment by segment."""
    found: list[list[tuple[int, int, int]]] = []
    for start, stop, data, offsets in slices(column):
        postings = scanner.postings(data, offsets)
        rows = {n: scanner.candidates(q, postings, stop - start).tolist() for n, q in enumerate(scanner.queries)}
        found += scanner.findings(column.slice(start, stop - start).to_pylist(), rows)
    return found


def scan(docs: DataFrame, keep: dict[str, Column], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns plus findings: array of (kind, start, end) by start and then rule order."""
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    names = list(keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = _found(scanner, batch.column(len(names)))
            spans = [[{"kind": rules[n].kind, "start": s, "end": e} for s, e, n in f] for f in found]
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(spans, kind)], [*names, "findings"])

    return kept.mapInArrow(find, ddl(kept, "findings array<struct<kind:string,start:int,end:int>>"))


def joined(findings: Column) -> Column:
    """kind:start:end of all findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every finding replaced by ``[kind]``; overlapping findings become one."""
    columns = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, at = Scanner(rules), columns.index(text)
        for batch in batches:
            found = _found(scanner, batch.column(at))
            changed = [i for i, spans in enumerate(found) if spans]
            if changed:
                values = batch.column(at).to_pylist()
                for i in changed:
                    parts, done = [], 0
                    for start, end, number in found[i]:
                        if start >= done:
                            parts += [values[i][done:start], f"[{rules[number].kind}]"]
                        done = max(done, end)
                    values[i] = "".join([*parts, values[i][done:]])
                whole = list(batch.columns)
                whole[at] = pa.array(values, pa.string())
                batch = pa.record_batch(whole, columns)
            yield batch

    return docs.mapInArrow(rewrite, docs.schema)
