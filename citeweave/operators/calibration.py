"""Threshold sweeps over scored pairs without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.metrics import coverage_ratio
from citeweave.operators.scale import exact_quantiles, running_totals

SCORE_BINS = 4096


def sweep(scored: DataFrame) -> DataFrame:
    """Confusion counts at every candidate threshold of ``scored(score, truth)``.

    Thresholds are the mid-points of neighbouring distinct scores plus one below
    the minimum and one above the maximum; a pair is predicted positive when its
    score reaches the threshold. Scores are grouped first, running counts come
    from fixed score bins, so the work is parallel even for one huge table.
    """
    distinct = scored.groupBy("score").agg(
        F.count_if(F.col("truth")).alias("pos"), F.count_if(~F.col("truth")).alias("neg")
    ).withColumn("bin", F.floor((F.col("score") + 1.0) * (SCORE_BINS / 2)))
    below = running_totals(distinct, [], "bin", [F.col("score")], {"pos_to": F.col("pos"), "neg_to": F.col("neg")})
    inside = Window.partitionBy("bin").orderBy("score")
    # The next distinct score is in the same bin or is the minimum of the next one.
    edges = distinct.groupBy("bin").agg(F.min("score").alias("bin_min"))
    next_bin = edges.select("bin", F.lead("bin_min").over(Window.orderBy("bin")).alias("next_min"))
    placed = below.join(next_bin, "bin").withColumn(
        "next_score", F.coalesce(F.lead("score").over(inside), F.col("next_min"))
    )
    totals = distinct.agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("score").alias("lowest")
    )
    all_pos, all_neg, lowest = (totals.select(c).scalar() for c in ("pos", "neg", "lowest"))
    above = placed.select(
        F.when(F.col("next_score").isNull(), F.col("score") + 1e-6)
        .otherwise((F.col("score") + F.col("next_score")) / 2.0)
        .alias("threshold"),
        (all_pos - F.col("pos_to")).alias("tp"),
        (all_neg - F.col("neg_to")).alias("fp"),
        F.col("neg_to").alias("tn"),
        F.col("pos_to").alias("fn"),
    )
    first = totals.select(
        (F.col("lowest") - 1e-6).alias("threshold"), F.col("pos").alias("tp"), F.col("neg").alias("fp"),
        F.lit(0).cast("bigint").alias("tn"), F.lit(0).cast("bigint").alias("fn"),
    )
    counted = above.unionByName(first)
    return counted.withColumns(
        {
            "recall": coverage_ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "specificity": coverage_ratio(F.col("tn"), F.col("tn") + F.col("fp")),
            "precision": coverage_ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        }
    ).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2.0)


def best_by_precision(swept: DataFrame) -> DataFrame:
    """Cosine calibration: balanced accuracy, precision, specificity, threshold."""
    row = F.max_by(
        F.struct(*swept.columns), F.struct("balanced_accuracy", "precision", "specificity", "threshold")
    )
    return swept.agg(row.alias("r")).select("r.*")


def best_by_balance(swept: DataFrame) -> DataFrame:
    """Entailment calibration: balanced accuracy, min(recall, specificity), precision.

    Remaining ties go to the lowest threshold, the first one in sweep order.
    """
    row = F.max_by(
        F.struct(*swept.columns),
        F.struct(
            F.col("balanced_accuracy"), F.least("recall", "specificity"), F.col("precision"), -F.col("threshold")
        ),
    )
    return swept.agg(row.alias("r")).select("r.*")


def acceptance(best: DataFrame, accuracy: float, recall: float, specificity: float) -> DataFrame:
    return best.withColumn(
        "acceptance_pass",
        (F.col("balanced_accuracy") >= accuracy) & (F.col("recall") >= recall) & (F.col("specificity") >= specificity),
    )


def score_summary(scored: DataFrame) -> DataFrame:
    """Min, quartiles and max per truth class."""
    edges = scored.groupBy("truth").agg(
        F.count("*").alias("pair_count"), F.min("score").alias("min"), F.max("score").alias("max")
    )
    return edges.join(
        exact_quantiles(scored, ["truth"], "score", {"p25": 0.25, "median": 0.5, "p75": 0.75}), "truth"
    )
