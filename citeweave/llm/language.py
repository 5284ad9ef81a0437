"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass over the labelled texts: a task adds up its own (language, bucket)
counts, Spark sums those rows. The log-probability matrix has ``buckets`` rows and one
column per learned language, so its size has a bound that is known before it is sent
to the tasks. Scoring gathers matrix rows for the n-grams of whole batches.

Defined results: null text or text without a letter gives ``und`` with score 0; so does
everything if no language could be learned. Ties go to the language that sorts first.
Repeated rows are scored alike; columns other than the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import ddl, stored
from citeweave.llm.textops import row_sums

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
MAX_LANGUAGES = 1000
CHARS = 1 << 19
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_ASCII = np.arange(128, dtype=np.uint32)
_ASCII[[i for i in range(128) if not chr(i).isalpha()]] = 32


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, code points, offsets); texts end with blanks, so no n-gram spans two."""
    start, size, parts = 0, 0, []
    for i, text in enumerate(texts):
        parts.append((text or "").lower())
        size += len(parts[-1])
        if size >= CHARS or i == len(texts) - 1:
            joined = "   ".join(parts) + "   "
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            low = points < 128
            points = np.where(low, _ASCII[np.where(low, points, 0)], points)
            sizes = np.array([len(p) for p in parts], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes + 3)])
            yield start, i + 1, points, offsets
            start, size, parts = i + 1, 0, []


def _grams(points: np.ndarray, orders: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each code point, for each order."""
    size = len(points) - max(orders) + 1
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for order in orders:
        value = np.full(size, 0x27D4EB2F * order & 0xFFFFFFFF, np.uint32)
        for place in range(order):
            value = (value ^ points[place : place + size]) * _FACTORS[place]
            value ^= value >> np.uint32(15)
        yield (value * np.uint32(0x2C1B3C6D)) >> shift


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # (buckets, languages), float32
    log_prior: np.ndarray
    orders: tuple[int, ...]


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS,
    smoothing: float = 0.5, max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Learn from all rows with a non-null language. ``buckets`` is a power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.record_batch(
                    [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                    ["lang", "bucket", "n"],
                )
            held.clear()

        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high, points, offsets in _blocks(texts):
                chosen = np.array(names[low:high], object)
                for name in set(names[low:high]):
                    if len(held) >= 64 and name not in held:
                        yield from drain()
                    counts = held.setdefault(name, np.zeros(buckets + 1, np.int64))
                    mine = chosen == name
                    counts[buckets] += mine.sum()  # the last cell counts texts
                    inside = np.repeat(mine, np.diff(offsets))[: len(points) - max(orders) + 1]
                    for grams in _grams(points, orders, buckets):
                        counts[:buckets] += np.bincount(grams[inside], minlength=buckets)
        yield from drain()

    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counted = known.mapInArrow(count, "lang string, bucket int, n bigint")
    sums = stored(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    names = tuple(sorted(r.lang for r in sums.select("lang").distinct().limit(max_languages + 1).collect()))
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages; the matrix has a column for each")
    counts = np.zeros((len(names), buckets + 1))
    place = {name: i for i, name in enumerate(names)}
    for row in sums.toLocalIterator():
        counts[place[row.lang], row.bucket] = row.n
    texts, grams = counts[:, buckets], counts[:, :buckets] + smoothing
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32) if names else grams
    prior = np.log(texts / texts.sum()) if names else texts
    return Model(names, np.ascontiguousarray(logs.T), prior, orders)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred and score, the posterior of the predicted language."""
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    matrix = docs.sparkSession.sparkContext.broadcast((model.log_probability, model.log_prior))
    languages, orders, names = np.array(model.languages, object), model.orders, list(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, prior = matrix.value
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            found, sure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for low, high, points, offsets in _blocks(texts) if len(languages) else ():
                totals = np.tile(prior, (high - low, 1))
                edges = np.minimum(offsets, len(points) - max(orders) + 1)
                for grams in _grams(points, orders, len(logs)):
                    totals += row_sums(logs[grams], edges)
                best = totals.argmax(axis=1)
                posterior = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
                lettered = np.array([_has_letter(t) for t in texts[low:high]], bool)
                found[low:high] = np.where(lettered, languages[best], UNKNOWN)
                sure[low:high] = np.where(lettered, posterior, 0.0)
            yield pa.record_batch(
                [*batch.columns[: len(names)], pa.array(found, pa.string()), pa.array(sure, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return kept.mapInArrow(score, ddl(kept, "lang_pred string", "score double"))
