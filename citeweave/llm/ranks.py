"""Row numbers inside groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import stored
from citeweave.operators.scale import running_totals


def numbered(rows: DataFrame, group: str, order: Sequence[str], number: str, total: str) -> DataFrame:
    """``rows`` with their 1-based ``number`` in ``group`` by ``order``, and the ``total`` of the group.

    ``group`` must not be null and ``rows`` must give the same rows in the same order when read again (stored rows
    do). A range sort deals the rows evenly; a group's number is the sum of the counts of its earlier
    partitions and the place inside the own one. The rows' place in their files decides between equal ones.
    """
    placed = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = stored(placed.repartitionByRange(group, *order, "__row").withColumn("__part", F.spark_partition_id()))
    columns = [F.col(c) for c in (*order, "__row")]
    return running_totals(
        dealt, [group], "__part", columns, {number: F.lit(1).cast("bigint")}, {number: total}
    ).drop("__row", "__part")
