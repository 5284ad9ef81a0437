"""Shards of equal row counts along a Hilbert curve over metadata dimensions.

Every dimension is quantised to ``2**bits`` bins of about equal row counts (quantiles over all
rows); the bins are the coordinates of a cell and the cell's place on the Hilbert curve orders the
rows. Runs of that order are the shards: rows of a shard are close in every dimension, so minima
and maxima of its files prune on any of them. The order is completed by the key and the size, so
copies and a hot value are cut like any other run.

Only narrow rows are sorted: texts stay where they are until ``write`` deals them out. Positions
come from a range-partitioned sort whose partitions are counted and then numbered on their own.

Law ``rows``: shard counts are at most one apart. Defined results: null texts have size 8 and the
checksum of the empty text; null dimension values are the lowest; rows that agree in every sorted
column are interchangeable; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeweave.llm.common import stored

BITS = 5
OVERHEAD = 8


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points (rows x dimensions, each below 2**bits), most significant bit first.

    The transposed index is found by undoing, level by level, the reflections and axis swaps that the
    curve applies inside each half, then Gray-decoding across the axes and interleaving the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(n):
            upper = (x[i] & level) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where(x[n - 1] & level, flip ^ (level - 1), flip)
        level >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def _numbers(df: DataFrame, dimensions: list[str]) -> dict[str, Column]:
    """Order-keeping numbers: of a text, six bytes after the prefix that all its values share."""
    texts = [d for d in dimensions if isinstance(df.schema[d].dataType, StringType)]
    out: dict[str, Column] = {d: F.col(d).cast("double") for d in dimensions}
    if texts:
        ends = df.agg(*[f(d).alias(f"{d}/{n}") for d in texts for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for d in texts:
            low, high = (ends[f"{d}/lo"] or "").encode(), (ends[f"{d}/hi"] or "").encode()
            same = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
            part = F.rpad(F.hex(F.substring(F.col(d).cast("binary"), same + 1, 6)), 12, "0")
            out[d] = F.conv(part, 16, 10).cast("double")
    return out


def assign(
    docs: DataFrame, dimensions: list[str], shards: int, key: str = "doc_id", text: str = "text", bits: int = BITS
) -> DataFrame:
    """(key, size, text_crc32, place, shard, slot); ``place`` is the index on the curve."""
    if shards < 1 or not dimensions or bits * len(dimensions) > 62:
        raise ValueError("needs a shard, a dimension and at most 62 bits")
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("__key"), (F.octet_length(whole) + OVERHEAD).cast("bigint").alias("__size"),
        F.crc32(whole.cast("binary")).alias("__crc"),
        *[(F.octet_length(whole) if d == text else F.col(d)).alias(f"__d{i}") for i, d in enumerate(dimensions)],
    )
    narrow = stored(narrow)
    names = [f"__d{i}" for i in range(len(dimensions))]
    numbers = _numbers(narrow, names)
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = narrow.agg(
        F.count("*").alias("n"), *[F.percentile_approx(numbers[d], cuts, 10_000).alias(d) for d in names]
    ).first()
    edges = [np.array(found[d] or [], float) for d in names]

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.array(batch.column(3 + i).to_pylist(), float) for i in range(len(names))]  # null: nan
            bins = [np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left")) for v, e in zip(values, edges, strict=True)]
            place = hilbert(np.minimum(np.stack(bins, axis=1), (1 << bits) - 1), bits)
            yield pa.record_batch([*batch.columns[:3], pa.array(place)], ["__key", "__size", "__crc", "__place"])

    kind = narrow.schema["__key"].dataType.simpleString()
    placed = narrow.select("__key", "__size", "__crc", *[numbers[d].alias(d) for d in names]).mapInArrow(
        curve, f"__key {kind}, __size bigint, __crc bigint, __place bigint"
    )
    order = ["__place", "__key", "__size", "__crc"]
    run = stored(placed.repartitionByRange(*order).withColumn("__run", F.spark_partition_id()))
    before, total = [0], 0
    counts = {r["__run"]: r.n for r in run.groupBy("__run").agg(F.count("*").alias("n")).collect()}
    for i in range(max(counts, default=-1) + 1):
        total += counts.get(i, 0)
        before.append(total)
    inside = F.row_number().over(Window.partitionBy("__run").orderBy(*order)).cast("bigint") - 1
    position = F.col("__at") + F.element_at(F.array(*[F.lit(b).cast("bigint") for b in before]), F.col("__run") + 1)
    numbered = run.withColumn("__at", inside).withColumn("__at", position)
    base, longer = divmod(total, shards)  # the first ``longer`` shards hold base + 1 rows
    edge = longer * (base + 1)
    at = F.col("__at")
    shard = F.when(at < edge, F.expr(f"__at div {base + 1}")).otherwise(
        F.lit(longer) + (F.expr(f"(__at - {edge}) div {max(base, 1)}"))
    )
    slot = F.when(at < edge, at % (base + 1)).otherwise((at - edge) % max(base, 1))
    return numbered.select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.col("__place").alias("place"), shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"),
    )


def write(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the documents as one folder per shard, rows by slot. The key must be unique."""
    placed = docs.join(shards.select(key, "shard", "slot"), key)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
