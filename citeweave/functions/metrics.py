"""Scalar formulas shared by the evaluation operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions.text import strip


def as_double(value: Column) -> Column:
    return value.cast("double")


def ratio_or(numerator: Column, denominator: Column, empty: float) -> Column:
    """numerator/denominator with a fixed value for an empty denominator."""
    return F.coalesce(F.try_divide(as_double(numerator), as_double(denominator)), F.lit(empty))


def coverage_ratio(numerator: Column, denominator: Column) -> Column:
    """0/0 counts as 0.0 (coverage convention)."""
    return ratio_or(numerator, denominator, 0.0)


def success_rate(numerator: Column, denominator: Column) -> Column:
    """0/0 counts as 1.0 (evaluation convention)."""
    return ratio_or(numerator, denominator, 1.0)


def signed_points(value: Column) -> Column:
    return F.format_string("%+.2f pp", value)


def status_class(status: Column) -> Column:
    """Load-test classes; null is a transport error."""
    return (
        F.when(status.isNull(), F.lit("transport_error"))
        .when(status.between(200, 299), F.lit("2xx"))
        .when(status.between(400, 499), F.lit("4xx"))
        .when(status.between(500, 599), F.lit("5xx"))
        .otherwise(F.lit("other"))
    )


def service_status_class(status: Column) -> Column:
    """Service metric classes 1xx..5xx."""
    return F.when(
        status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))
    ).otherwise(F.lit("other"))


def provider_kind(name: Column) -> Column:
    folded = F.lower(strip(name))
    return (
        F.when(folded.isin("fake", "deterministic", "extractive"), F.lit("deterministic"))
        .when(folded.isin("transformers", "huggingface"), F.lit("local_model"))
        .otherwise(F.lit("remote"))
    )


def null_strict_sum(values: Column) -> Column:
    """Sum of an array, null as soon as one element is null, rounded to 3."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.exists(values, lambda v: v.isNull()), F.lit(None).cast("double")).otherwise(F.round(total, 3))


def softmax(scores: Column) -> Column:
    """Probabilities from raw scores; rows that already are probabilities pass through."""
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    raw_total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    already = F.forall(scores, lambda x: (x >= 0.0) & (x <= 1.0)) & (F.abs(raw_total - 1.0) <= 1e-4)
    return F.when(already, scores).otherwise(F.transform(exps, lambda e: e / total))
