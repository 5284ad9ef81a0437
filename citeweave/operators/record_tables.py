"""Receipts, visual assets, annotation tasks and training-example records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLE_TYPES = ["ordinary", "synthesis", "refusal"]
TOTALS = ["question_attempts", "verification_attempts", "answer_attempts", "input_tokens", "output_tokens"]
IGNORED_LABEL = -100


def receipt_summary(receipts: DataFrame) -> DataFrame:
    """Counts by status and type, attempt, token and cost totals."""
    accepted = F.col("status") == "accepted"
    return receipts.agg(
        F.count("*").alias("record_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("accepted", "rejected", "failed")],
        *[F.count_if(accepted & (F.col("example_type") == t)).alias(f"{t}_accepted_count") for t in EXAMPLE_TYPES],
        *[F.sum(c).alias(f"total_{c}") for c in TOTALS],
        F.sum("total_tokens").alias("total_tokens"),
        F.round(F.sum("estimated_cost_usd"), 6).alias("total_estimated_cost_usd"),
        F.min("telemetry_complete").alias("telemetry_complete"),
    )


def visual_asset_id(page_id: Column, asset_type: Column, asset_index: Column) -> Column:
    return F.format_string("%s:%s:%03d", page_id, asset_type, asset_index)


def annotation_tasks(assets: DataFrame, version: str) -> DataFrame:
    """One task per asset; the id names the asset and the task version."""
    return assets.select(
        F.concat("asset_id", F.lit(f":annotation:{version}")).alias("task_id"),
        F.lit(version).alias("task_version"), F.col("asset_id"), *[c for c in assets.columns if c != "asset_id"],
    )


def page_representatives(assets: DataFrame) -> DataFrame:
    """The first asset of every page under (type, index)."""
    rest = [c for c in assets.columns if c != "page_id"]
    return assets.groupBy("page_id").agg(
        F.min_by(F.struct(*rest), F.struct("asset_type", "asset_index")).alias("r")
    ).select("page_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def chat_messages(system: Column, user: Column, response: Column) -> Column:
    """System, user and assistant messages of one training row."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", system), message("user", user), message("assistant", F.to_json(response)))


def assistant_labels(input_ids: Column, start: Column) -> Column:
    """Labels that supervise only the tokens from ``start`` (0-based) on."""
    masked = F.array_repeat(F.lit(IGNORED_LABEL).cast("bigint"), start.cast("int"))
    return F.concat(masked, F.slice(input_ids, (start + 1).cast("int"), F.size(input_ids)))


def supervised_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda label: label != IGNORED_LABEL))


def pending_plans(plans: DataFrame, receipts: DataFrame) -> DataFrame:
    """Plans without an accepted receipt."""
    return plans.join(receipts.where("status = 'accepted'").select("plan_id").distinct(), "plan_id", "left_anti")
