"""Evenly spread rows of a sorted table, without numbering the table."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.session import stored


def wanted_ranks(rows: int, count: int) -> list[int]:
    """0-based ranks: ``count`` of them from first to last, the middle for one; halves round to even."""
    if count < 1:
        raise ValueError("count must be at least 1")
    if count >= rows:
        return list(range(rows))
    if count == 1:
        return [rows // 2]
    return [round(at * (rows - 1) / (count - 1)) for at in range(count)]


def select_spread(rows: DataFrame, size: str, key: str, count: int) -> DataFrame:
    """``rows`` at ``count`` evenly spread places of their order by (size, key).

    One range sort deals the rows into ordered partitions. Their row counts, one number per partition, tell which
    of them hold a wanted rank; only those are numbered, each on its own. Fewer rows than ``count`` are
    all returned, without a sort.
    """
    total = rows.limit(count + 1).count()
    if total <= count:
        return rows
    dealt = stored(rows.repartitionByRange(size, key).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    ends = list(accumulate(n for _, n in sizes))
    places = []
    for rank in wanted_ranks(ends[-1], count):
        at = bisect_right(ends, rank)
        places.append((sizes[at][0], rank - (ends[at - 1] if at else 0) + 1))
    wanted = rows.sparkSession.createDataFrame(places, "__part int, __at int")  # ``count`` rows
    held = dealt.where(F.col("__part").isin(sorted({p for p, _ in places})))
    numbered = held.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(size, key)))
    return numbered.join(wanted, ["__part", "__at"]).select(rows.columns)
