"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled 1; every document is unlabelled web text. Labels 0 are
never used. A document becomes a short vector of shape statistics of its whole text. The class
prior is the smallest ratio of unlabelled to positive mass above a threshold of a first
positive-against-unlabelled fit: where no negative reaches, that ratio is the prior.

With the logistic loss the unbiased risk is ``-prior * E_P[f] + E_U[log(1 + exp(f))]``. Its
sums (loss, gradient, curvature) are additive over rows, so a step is one Spark aggregation
over the stored vectors of ALL documents. When the negative part of the risk,
``E_U[l(-f)] - prior * E_P[l(-f)]``, falls below zero, the step goes up that part's gradient.

Defined results: null and empty texts have the zero vector before standardising and are scored
like any other; without a positive label or a document every score is the given ``prior``.
Repeated rows are scored alike and weigh as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import ddl, stored
from citeweave.llm.textops import list_array, row_sums, slices, words

FEATURES = (
    "log words", "letters", "capitals", "digits", "blanks", "line ends", "bars", "shouts", "symbols", "other marks",
    "word length", "word length spread", "distinct words", "echoed words", "commonest word", "marked words",
    "capital words", "words per line",
)
CLIP = 6.0
_KIND = np.full(256, 0, np.uint8)  # letters and bytes beyond ASCII
_KIND[0:128] = 6
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 32]] = 3
_KIND[[10, 13]] = 4
_KIND[[ord("|")]] = 5
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]\\=_+"]] = 7
_KIND[[ord("!"), ord("?")]] = 8


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    found = words(data, offsets)
    if not len(found.starts):
        return out
    kind = _KIND[data]
    size = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    share = np.bincount(owner * 9 + kind, minlength=rows * 9).reshape(rows, 9)
    letters = share[:, 0] + share[:, 1]
    count = np.diff(found.first)
    some = np.maximum(count, 1)
    length = (found.ends - found.starts).astype(float)
    mean = row_sums(length, found.first) / some
    square = row_sums(length**2, found.first) / some
    order = np.lexsort((found.hashes, found.rows))
    hashes, owners = found.hashes[order], found.rows[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]))
    runs = np.diff(np.append(np.flatnonzero(new), len(new)))
    most = np.zeros(rows)
    np.maximum.at(most, owners[new], runs)
    echo = np.append(False, (found.hashes[1:] == found.hashes[:-1]) & (found.rows[1:] == found.rows[:-1]))
    marked = np.isin(kind[found.ends - 1], (7, 8))
    capital = np.add.reduceat((kind == 1).astype(np.int64), found.starts)
    small = np.add.reduceat((kind == 0).astype(np.int64), found.starts)
    shouted = (capital >= 2) & (small <= capital * 0.2)
    lines = share[:, 4] + 1
    out[:] = np.stack(
        [
            np.log1p(count), letters / size, share[:, 1] / np.maximum(letters, 1), share[:, 2] / size, share[:, 3] / size,
            share[:, 4] / size, share[:, 5] / some, share[:, 8] / some, share[:, 7] / some, share[:, 6] / size,
            mean, np.sqrt(np.maximum(square - mean**2, 0)), np.bincount(owners[new], minlength=rows) / some,
            row_sums(echo.astype(float), found.first) / some, most / some, row_sums(marked.astype(float), found.first) / some,
            row_sums(shouted.astype(float), found.first) / some, np.log1p(count / lines),
        ],
        axis=1,
    )
    out[count == 0] = 0
    return out


def featurise(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` columns plus x, the feature vector of the whole text."""
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    names = list(keep)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [vectors(data, offsets) for _, _, data, offsets in slices(batch.column(len(names)))]
            flat = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            first = np.arange(len(flat) + 1) * len(FEATURES)
            yield pa.record_batch(
                [*batch.columns[: len(names)], list_array(flat.ravel(), first, pa.float32())], [*names, "x"]
            )

    return kept.mapInArrow(measure, ddl(kept, "x array<float>"))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last one is the bias
    prior: float


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(FEATURES)).astype(np.float64)


def _design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / spread, -CLIP, CLIP), np.ones((len(x), 1))])


def _total(rows: DataFrame, width: int, partial) -> np.ndarray:
    """Sum over all rows of the ``width`` numbers that ``partial(x, positive)`` gives for a batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column(0)), np.asarray(batch.column(1)).astype(bool))
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(total)], ["i", "v"])

    sums = rows.select("x", "positive").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for row in sums:
        out[row.i] = row.v
    return out


def _minimise(rows: DataFrame, mean, spread, prior: float | None, steps: int, ridge: float) -> np.ndarray:
    """Weights of the non-negative risk; without a prior, of positive against unlabelled."""
    d = len(FEATURES) + 1
    weights = np.zeros(d)

    def sums(x: np.ndarray, positive: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = _design(x, mean, spread)
        f = z @ at
        p = 1 / (1 + np.exp(-f))
        zp, pp = z[positive], p[positive]
        return np.concatenate(
            [
                [len(z), len(zp), np.logaddexp(0, f).sum(), np.logaddexp(0, f[positive]).sum()],
                p @ z, zp.sum(axis=0), pp @ zp, ((z * (p * (1 - p))[:, None]).T @ z).ravel(),
                ((zp * (pp * (1 - pp))[:, None]).T @ zp).ravel(),
            ]
        )

    for _ in range(steps):
        got = _total(rows, 4 + 3 * d + 2 * d * d, lambda x, y, at=weights: sums(x, y, at))
        n, m, loss_u, loss_p = got[:4]
        up, sp, pp = got[4 : 4 + d] / n, got[4 + d : 4 + 2 * d] / m, got[4 + 2 * d : 4 + 3 * d] / m
        curve_u = got[4 + 3 * d : 4 + 3 * d + d * d].reshape(d, d) / n
        curve_p = got[4 + 3 * d + d * d :].reshape(d, d) / m
        if prior is None:  # equal weight for both sides
            gradient, curve = up + pp - sp, curve_u + curve_p
        elif loss_u / n - prior * loss_p / m < 0:
            weights = weights + 0.1 * (up - prior * pp)
            continue
        else:
            gradient, curve = up - prior * sp, curve_u
        step = np.linalg.solve(curve + ridge * np.eye(d), gradient + ridge * weights)
        weights = weights - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return weights


def fit(rows: DataFrame, steps: int = 12, ridge: float = 1e-3, least_mass: float = 0.2, prior: float = 0.5) -> Model:
    """Learn from stored ``rows`` with x and a boolean ``positive``; ``prior`` is used if there is no positive."""
    d = len(FEATURES)
    first = _total(rows, 2 + 2 * d, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x**2).sum(axis=0)]))
    if first[0] == 0 or first[1] == 0:
        return Model(np.zeros(d), np.ones(d), np.append(np.zeros(d), np.log(prior / (1 - prior))), prior)
    mean = first[2 : 2 + d] / first[0]
    spread = np.sqrt(np.maximum(first[2 + d :] / first[0] - mean**2, 0))
    spread[spread < 1e-9] = 1.0
    rough = _minimise(rows, mean, spread, None, steps, ridge)
    cells = 400

    def histogram(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(_design(x, mean, spread) @ rough)))
        at = np.minimum((p * cells).astype(int), cells - 1)
        return np.concatenate([np.bincount(at, minlength=cells), np.bincount(at[positive], minlength=cells)])

    counts = _total(rows, 2 * cells, histogram)
    above_u = np.cumsum(counts[:cells][::-1]) / first[0]
    above_p = np.cumsum(counts[cells:][::-1]) / first[1]
    ratio = (above_u / np.maximum(above_p, 1e-12))[above_p >= least_mass]
    estimated = float(np.clip(ratio.min(), 0.01, 0.99))
    return Model(mean, spread, _minimise(rows, mean, spread, estimated, steps, ridge), estimated)


def score(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns plus score, the probability of a good document."""
    terms = [
        F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col("x")[i].cast("double") - float(m)) / float(s))) * float(w)
        for i, (m, s, w) in enumerate(zip(model.mean, model.spread, model.weights[:-1], strict=True))
    ]
    logit = sum(terms, F.lit(float(model.weights[-1])))
    return rows.select(*keep, (1 / (1 + F.exp(-logit))).alias("score"))


def training_rows(
    docs: DataFrame, positives: DataFrame, keep: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Stored (``keep``, x, positive) of every document; ``positives`` has the distinct ids (``key``) of trusted ones."""
    keep = keep or {}
    measured = featurise(docs, {**keep, "__key": F.col(key)}, text)
    marks = positives.select(F.col("key").alias("__key"), F.lit(True).alias("__mark"))
    joined = measured.join(marks, "__key", "left")
    return stored(joined.select(*keep, "x", F.coalesce("__mark", F.lit(False)).alias("positive")))


def classify(
    docs: DataFrame, positives: DataFrame, keep: dict[str, Column], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``keep`` columns plus score of every document."""
    rows = training_rows(docs, positives, keep, key, text)
    return score(rows, fit(rows), list(keep))
