"""JSON Lines tables with closed schemas, canonical sinks and key guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_records(spark: SparkSession, path: str | list[str], ddl: str, strict: bool = True) -> DataFrame:
    """Read JSON Lines under a fixed schema.

    ``strict`` fails on the first malformed line; otherwise broken lines are
    kept in ``_corrupt`` for ``rejected_rows``. Blank lines are skipped.
    """
    if strict:
        return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)
    return (
        spark.read.schema(f"{ddl}, {CORRUPT} STRING").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def unknown_fields(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Top-level fields that the closed schema does not know, with row counts."""
    known = [f.name for f in T._parse_datatype_string(ddl).fields]
    keys = spark.read.text(path).where(F.trim("value") != "").select(
        F.explode(F.json_object_keys("value")).alias("field")
    )
    return keys.where(~F.col("field").isin(*known)).groupBy("field").agg(F.count("*").alias("rows"))


def canonical_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with fields in name order and nulls kept."""
    return df.select(
        F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value")
    )


def write_records(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write JSON Lines; ``order`` gives a globally range-sorted set of files."""
    rows = df.orderBy(*order) if order else df
    canonical_json(rows).write.mode(mode).text(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a one-row report as a single JSON object."""
    canonical_json(df).coalesce(1).write.mode(mode).text(path)


def read_report(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Return ``df`` after checking that no key repeats."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"duplicate key {[tuple(r)[:-1] for r in repeated]}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("at least one record is required")
    return df


def read_batches(spark: SparkSession, pattern: str, ddl: str, expected_files: int) -> DataFrame:
    """Decision batches of a glob; the number of files must be as agreed."""
    rows = read_records(spark, pattern, ddl)
    seen = rows.select(F.input_file_name().alias("f")).distinct().count()
    if seen != expected_files:
        raise ValueError(f"expected {expected_files} batch files, found {seen}")
    return rows


def append_checkpoint(checkpoints: DataFrame, path: str) -> None:
    """Append-only checkpoint table partitioned by thread; existing ids are refused."""
    spark = checkpoints.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if exists:
        stored = spark.read.parquet(path).select("thread_id", "sequence")
        clash = checkpoints.join(stored, ["thread_id", "sequence"], "left_semi")
        if not clash.isEmpty():
            raise FileExistsError("checkpoint sequence already stored")
    checkpoints.write.mode("append").partitionBy("thread_id").parquet(path)
