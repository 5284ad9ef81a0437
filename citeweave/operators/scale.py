"""Building blocks that keep every operator distributed under skew.

* ``fits`` measures a side before it is broadcast.
* ``with_group_values`` joins aggregates of a group back to its rows in two levels.
* ``running_totals`` and ``global_row_number`` number rows in two levels, so no
  single task ever sorts a whole table or a whole hot group.
* ``exact_quantiles`` finds order statistics from per-bin counts and only then
  looks at the rows of the bins that hold them.
* ``top_k`` is written so that Spark plans a partial limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 64
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 * 1024 * 1024


def _row_bytes(df: DataFrame) -> Column:
    """Approximate bytes of a row: text lengths, eight per number or element."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(column)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            size = F.octet_length(F.array_join(column, "        "))
        elif isinstance(field.dataType, T.ArrayType):
            size = F.size(column) * 8
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(8)).cast("bigint")
    return total


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, per_row: int = 1) -> bool:
    """True when ``df`` is small enough to broadcast: rows and bytes are measured.

    ``per_row`` is for a table derived from ``df`` that has at most that many
    rows for each of its rows, such as the top-k hits of a query table.
    """
    measured = df.limit(max_rows + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")
    ).first()
    return measured.n * per_row <= max_rows and measured.b * per_row <= max_bytes


def small(df: DataFrame, bounded: bool) -> DataFrame:
    """Broadcast ``df`` when its size was shown to be bounded."""
    return F.broadcast(df) if bounded else df


def top_k(
    df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int, rank_name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each partition under a total order.

    Filtering ``row_number`` lets Spark place a WindowGroupLimit below the
    exchange: every task keeps at most ``k`` rows per group before shuffling.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).where(F.col(rank_name) <= k)


def running_totals(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], totals: dict[str, Column],
    overall: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums per key in bucket-then-``order`` order.

    ``overall`` maps a name of ``totals`` to a column for its sum over the key.

    ``bucket`` must be a column that grows with ``order``. Bucket sums are
    combined map-side, prefix-summed over the (few) buckets and joined back, so
    the row-level windows only ever span one bucket.
    """
    group = [*keys, bucket]
    sums = df.groupBy(*group).agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    overall = overall or {}
    offsets = sums.select(
        *group,
        *[F.sum(f"__sum_{n}").over(whole).alias(alias) for n, alias in overall.items()],
        *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__base_{n}") for n in totals],
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, group, "inner")
    numbered = joined.select(
        *df.columns,
        *overall.values(),
        *[(F.col(f"__base_{n}") + F.sum(c).over(inside)).alias(n) for n, c in totals.items()],
    )
    return numbered


def with_group_values(
    df: DataFrame, key: str, spread_by: Sequence[str], values: dict[str, tuple[Column, Callable[[str], Column]]],
    salts: int = SALTS,
) -> DataFrame:
    """Every row with aggregates of its group, for keys that may hold a third of all rows.

    ``values`` maps a name to (aggregate of rows, function that merges partial aggregates). Rows are placed by
    (key, salt), the salt coming from ``spread_by``; the group values go back to at most ``salts`` partial rows
    per key, so no task meets a whole group. Rows with a null key are left out.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    partial = salted.groupBy(key, "__salt").agg(*[first.alias(n) for n, (first, _) in values.items()])
    whole = partial.groupBy(key).agg(*[merge(n).alias(n) for n, (_, merge) in values.items()])
    placed = partial.select(key, "__salt").join(whole, key)
    return salted.join(placed, [key, "__salt"]).select(*df.columns, *values)


def global_row_number(
    df: DataFrame, bucket: Column, order: Sequence[Column], name: str = "row_no"
) -> DataFrame:
    """1-based number over the whole table; ``bucket`` grows with ``order``."""
    staged = df.withColumn("__bucket", bucket)
    return running_totals(staged, [], "__bucket", order, {name: F.lit(1).cast("bigint")}).drop("__bucket")


def _magnitude_bin(value: Column) -> Column:
    """Monotone bin of fixed relative width, usable for any double."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * 256)).cast("bigint")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], nearest_rank: Sequence[str] = ()
) -> DataFrame:
    """Exact order statistics per key, one column per entry of ``quantiles``.

    Linear interpolation at ``q * (n - 1)`` unless the name is listed in
    ``nearest_rank``, which takes the value at ``bround(q * (n - 1))``.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    binned = rows.withColumn("__bin", _magnitude_bin(F.col("__v")))
    bins = binned.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    bins = bins.select(
        *keys, "__bin", "__n",
        F.sum("__n").over(upto).alias("__upto"),
        F.sum("__n").over(whole).alias("__total"),
    )
    # Every statistic is lo + (hi - lo) * fraction of two neighbouring positions.
    wanted = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("__total") - 1)
        low = F.bround(position) if name in nearest_rank else F.floor(position)
        fraction = F.lit(0.0) if name in nearest_rank else position - low
        low = low.cast("bigint")
        wanted.append((f"{name}/lo", low, fraction))
        wanted.append((f"{name}/hi", F.least(low + 1, F.col("__total") - 1), fraction))
    first = F.col("__upto") - F.col("__n")
    specs = F.array(
        *[F.struct(F.lit(n).alias("name"), p.alias("pos"), w.alias("weight")) for n, p, w in wanted]
    )
    hits = bins.select(
        *keys, "__bin", first.alias("__first"),
        F.explode(
            F.filter(specs, lambda s: (s["pos"] >= first) & (s["pos"] < F.col("__upto")))
        ).alias("__want"),
    )
    counted = (
        binned.join(hits.select(*keys, "__bin").distinct(), [*keys, "__bin"], "left_semi")
        if keys
        else binned.join(hits.select("__bin").distinct(), ["__bin"], "left_semi")
    ).groupBy(*keys, "__bin", "__v").agg(F.count("*").alias("__c"))
    inside = (
        Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = counted.withColumn("__end", F.sum("__c").over(inside))
    picked = placed.join(hits, [*keys, "__bin"]).where(
        (F.col("__want.pos") - F.col("__first") < F.col("__end"))
        & (F.col("__want.pos") - F.col("__first") >= F.col("__end") - F.col("__c"))
    )
    return picked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("__want.name") == f"{n}/{side}", F.struct("__v", "__want.weight"))).alias(f"{n}/{side}")
            for n in quantiles
            for side in ("lo", "hi")
        ]
    ).select(
        *keys,
        *[
            (
                F.col(f"`{n}/lo`.__v")
                + (F.col(f"`{n}/hi`.__v") - F.col(f"`{n}/lo`.__v")) * F.col(f"`{n}/lo`.weight")
            ).alias(n)
            for n in quantiles
        ],
    )
