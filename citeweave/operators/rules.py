"""Declared invariants over nested rows, compiled to one expression per row.

A ``Rule`` names a ``Check``: a predicate that is true for a broken row, and a text saying what broke it. Combinators build
checks on array columns, so a table is read once, nothing is exploded before the verdict, and a row gives
all of its violations. A predicate that is null counts as broken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Check(NamedTuple):
    broken: Column
    detail: Column


class Rule(NamedTuple):
    name: str
    check: Check


def holds(condition: Column, detail: Column | None = None) -> Check:
    """The condition must be true."""
    return Check(F.coalesce(~condition, F.lit(True)), F.lit("") if detail is None else detail.cast("string"))


def filled(value: Column) -> Check:
    """A text must have more than blanks."""
    return holds(F.length(F.trim(value)) > 0)


def unique(values: Column) -> Check:
    """No value twice; the detail lists those that are."""
    again = F.filter(values, lambda v, i: F.array_position(values, v) <= i)
    return holds(F.size(again) == 0, F.array_join(F.array_sort(F.array_distinct(again.cast("array<string>"))), ","))


def at_least(values: Column, least: Column | int) -> Check:
    least = F.lit(least) if isinstance(least, int) else least
    return holds(F.size(values) >= least, F.size(values))


def at_most(values: Column, most: Column | int) -> Check:
    most = F.lit(most) if isinstance(most, int) else most
    return holds(F.size(values) <= most, F.size(values))


def within(values: Column, known: Column) -> Check:
    """Every value is one of ``known``; the detail lists the others."""
    unknown = F.array_except(values, known)
    return holds(F.size(unknown) == 0, F.array_join(F.array_sort(unknown.cast("array<string>")), ","))


def lacks(text: Column, pattern: str) -> Check:
    """A regular expression must not occur; the detail is its first match."""
    found = F.regexp_substr(text, F.lit(pattern))
    return holds(text.isNotNull() & found.isNull(), F.coalesce(found, F.lit("")))


def each(items: Column, check: Callable[[Column], Check]) -> Check:
    """The check holds for every element; the detail lists the 1-based places that break it."""
    places = F.filter(
        F.transform(items, lambda v, i: F.when(check(v).broken, F.concat_ws(" ", (i + 1).cast("string"), F.nullif(check(v).detail, F.lit(""))))),
        lambda x: x.isNotNull(),
    )
    return holds(F.size(places) == 0, F.array_join(places, ";"))


def when(condition: Column, check: Check) -> Check:
    """The check counts only where the condition is true."""
    return Check(F.coalesce(condition, F.lit(False)) & check.broken, check.detail)


def violations(rows: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, check_name, detail) for every broken rule of every row."""
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rule names must differ")
    found = F.array_compact(F.array(*[
        F.when(r.check.broken, F.struct(F.lit(r.name).alias("check_name"), F.coalesce(r.check.detail, F.lit("")).alias("detail")))
        for r in rules
    ]))
    return rows.select(key, F.explode(found).alias("v")).select(key, "v.check_name", "v.detail")


def sound(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that break no rule."""
    bad = F.lit(False)
    for r in rules:
        bad = bad | r.check.broken
    return rows.where(~bad)
