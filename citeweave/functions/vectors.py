"""Vector expressions and the pluggable text encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIMENSIONS = 64
BLOCK_ROWS = 256

Encoder = Callable[[pd.Series], np.ndarray]


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(vector: Column) -> Column:
    """Unit-length copy in double precision; a zero vector is an error."""
    size = norm(vector)
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size)).otherwise(
        F.raise_error(F.lit("zero vector cannot be normalized")).cast("array<double>")
    )


def dot(left: Column, right: Column) -> Column:
    pairs = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    value = dot(left, right) / (norm(left) * norm(right))
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)), 8)


@lru_cache(maxsize=50_000)
def _slot(word: str) -> int:
    return int(hashlib.sha256(word.encode("utf-8")).hexdigest()[:8], 16) % HASH_DIMENSIONS


def hashed_counts(texts: pd.Series) -> np.ndarray:
    """Default encoder: word counts hashed into a fixed number of slots.

    It stands in for a sentence model. Counts are small integers, so float32
    storage is exact and the vectors do not depend on batching.
    """
    out = np.zeros((len(texts), HASH_DIMENSIONS), dtype=np.float32)
    for row, text in enumerate(texts):
        slots = list(map(_slot, (text or "").lower().split()))
        if slots:
            out[row] = np.bincount(slots, minlength=HASH_DIMENSIONS)
    return out


def encode(text: Column, encoder: Encoder = hashed_counts) -> Column:
    """Embed a text column with any batch encoder, ``BLOCK_ROWS`` texts at a time.

    Only a block's texts are Python strings at once, however many rows Spark puts into an Arrow batch.
    """
    kind = pa.list_(pa.float32())

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            blocks = [pa.array([], kind)]
            for start in range(0, len(batch), BLOCK_ROWS):
                texts = pd.Series(batch.slice(start, BLOCK_ROWS).to_pylist(), dtype=object)
                blocks.append(pa.array(list(encoder(texts)), kind))
            yield pa.concat_arrays(blocks)

    return run(text)
