"""Aggregates inside arrays that know what is missing: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_known(items: Column, *parts: Callable[[Column], Column]) -> Column:
    """True if every part of every element is there; true for an empty or missing array."""
    known = F.lit(True)
    for part in parts:
        known = known & F.forall(items, lambda x: part(x).isNotNull())
    return F.coalesce(known, F.lit(True))


def known_total(items: Column, part: Callable[[Column], Column], kind: str, needs: Callable[[Column], Column] | None = None) -> Column:
    """Sum, of type ``kind``, of a part over the elements that have it, and also have ``needs``."""
    zero = F.lit(0).cast(kind)

    def value(x: Column) -> Column:
        given = part(x) if needs is None else F.when(needs(x), part(x))
        return F.coalesce(given.cast(kind), zero)

    return F.coalesce(F.aggregate(items, zero, lambda total, x: (total + value(x)).cast(kind)), zero)


def strict_total(items: Column, part: Callable[[Column], Column], kind: str) -> Column:
    """Sum, of type ``kind``, of a part, null as soon as one element lacks it or there is no element."""
    whole = F.aggregate(items, F.lit(0).cast(kind), lambda total, x: (total + part(x)).cast(kind))
    return F.when(F.size(items) > 0, whole)


def known_values(items: Column, part: Callable[[Column], Column]) -> Column:
    """The parts that are there, in order."""
    values = F.filter(F.transform(items, lambda x: part(x)), lambda v: v.isNotNull())
    return F.coalesce(values, F.array().cast("array<string>"))
