"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import by_merge, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links(a, b)``; the component is its smallest id.

    A round takes the smallest label among an id's neighbours and then the label of that label. Both
    sides of each join are stored rows, so a node with very many links is split by the skew rule.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(
        links.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    edges = stored(both.where("id <> other").distinct())
    labels = stored(edges.groupBy("id").agg(F.min("other").alias("near")).select("id", F.least("id", "near").alias("label")))
    for _ in range(rounds):
        heard = edges.join(by_merge(labels.select(F.col("id").alias("other"), "label")), "other").groupBy("id").agg(
            F.min("label").alias("heard")
        )
        lower = stored(
            labels.join(by_merge(heard), "id").select("id", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        )
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("root"))
        after = stored(
            lower.join(by_merge(jump), "label", "left").select("id", F.coalesce("root", "label").alias("label"), "was")
        )
        settled = after.where("label <> was").isEmpty()
        labels = after.select("id", "label")
        if settled:
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
