"""Shared pieces of the operators: tables, checkpoints, label folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def by_merge(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data and is never sent to the driver.

    Left to itself, Spark broadcasts a side by the bytes of its shuffled rows, or by those below an explode; the table that
    the driver builds of it takes several times as much, and several of them are built at once.
    """
    return df.hint("merge")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row per labelled id: (key, y). Rows without id or label are left out; where labels of
    an id disagree, the smaller one holds."""
    return (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(F.col(label)).cast("int").alias("y"))
    )


def ddl(kept: DataFrame, *more: str) -> str:
    """Schema text: the columns of ``kept`` but its last, which is the input, and ``more``."""
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]], *more])


def array_total(rows: DataFrame, length: int, partial, slab: int = 1 << 12) -> np.ndarray:
    """Sum over all tasks of the ``length`` numbers that ``partial(batch)`` gives for each batch of ``rows``.

    A task adds up its batches and sends slabs; slabs are added in two levels, so no group is larger than the
    number of tasks divided by 64, and the driver gets one sum.
    """

    def add_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            total += partial(batch)
        starts = range(0, length, slab)
        part = TaskContext.get().partitionId() % 64
        yield pa.record_batch(
            [
                pa.array(starts, pa.int32()), pa.array([part] * len(starts), pa.int32()),
                pa.array([total[s : s + slab].astype("<f8").tobytes() for s in starts], pa.binary()),
            ],
            ["start", "part", "sums"],
        )

    def add(frame):
        total = np.sum([np.frombuffer(b, "<f8") for b in frame["sums"]], axis=0)
        return frame.iloc[:1].assign(sums=[total.astype("<f8").tobytes()])

    kind = "start int, part int, sums binary"
    sums = rows.mapInArrow(add_batches, kind).groupBy("start", "part").applyInPandas(add, kind)
    out = np.zeros(length)
    for row in sums.groupBy("start").applyInPandas(add, kind).collect():
        out[row.start : row.start + slab] = np.frombuffer(row.sums, "<f8")
    return out
