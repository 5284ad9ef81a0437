"""Row, key and table constraints as data: every violation is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = ["check_name", "row_key", "detail"]


def rows_where(df: DataFrame, name: str, key: str, broken: Column, detail: Column | None = None) -> DataFrame:
    """Rows that break a predicate."""
    return df.where(F.coalesce(broken, F.lit(True))).select(
        F.lit(name).alias("check_name"), F.col(key).cast("string").alias("row_key"),
        (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
    )


def duplicate_keys(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit(name).alias("check_name"), F.concat_ws(":", *keys).alias("row_key"),
        F.col("n").cast("string").alias("detail"),
    )


def orphans(child: DataFrame, parent: DataFrame, name: str, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without parent, counted per key."""
    keys = parent.select(F.col(parent_key).alias("__k")).distinct()
    lost = child.select(F.col(child_key).alias("__k")).join(keys, "__k", "left_anti")
    return lost.groupBy("__k").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("check_name"), F.col("__k").cast("string").alias("row_key"),
        F.col("n").cast("string").alias("detail"),
    )


def varying_within(df: DataFrame, name: str, key: str, columns: list[str]) -> DataFrame:
    """Keys whose columns are not constant."""
    varying = F.array_compact(
        F.array(*[F.when(~F.min(c).eqNullSafe(F.max(c)), F.lit(c)) for c in columns])
    )
    return df.groupBy(key).agg(varying.alias("fields")).where(F.size("fields") > 0).select(
        F.lit(name).alias("check_name"), F.col(key).cast("string").alias("row_key"),
        F.array_join("fields", ",").alias("detail"),
    )


def differing_columns(left: DataFrame, right: DataFrame, name: str, key: str, columns: list[str]) -> DataFrame:
    """Shared keys whose columns disagree between two tables."""
    l, r = left.select(key, *columns).alias("l"), right.select(key, *columns).alias("r")
    fields = F.array_compact(
        F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns])
    )
    return l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}")).select(
        F.lit(name).alias("check_name"), F.col(f"l.{key}").cast("string").alias("row_key"), fields.alias("f")
    ).where(F.size("f") > 0).select("check_name", "row_key", F.array_join("f", ",").alias("detail"))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("check_name").agg(F.count("*").alias("violations"))


def enforce(violations: DataFrame) -> None:
    """Raise on the first violations (at most five are fetched for the message)."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.check_name}({r.row_key}) {r.detail}".strip() for r in found))
