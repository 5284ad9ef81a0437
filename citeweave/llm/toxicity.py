"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of the labelled rows: at most ``per_class`` ids of either label and
``SAMPLE_BYTES`` bytes of their whole texts, those with the smallest hash of the id. Every term of an
example is a dimension; nothing else bounds the vectors. A term weighs
``(1 + ln tf) * idf * (FLOOR + chi)``, where idf comes from document frequencies over ALL
documents and chi is the term's chi-square for the label: terms that say nothing about the label count little,
none is cut out.

The index keeps postings (example, weight) by term and block of examples, with the largest weight of each.
A document's weights times those maxima bound its cosines in a block; the block with the best bound is opened
first, others only where the k-th best cosine does not exceed their bound. Examples are ordered by the
pilot example they are nearest to, so that blocks share terms. Neighbours (positive cosine) vote with
weight ``1 / (1.05 - cosine)``; a logistic curve fitted to the examples' leave-one-out votes, weighted back
to the label counts of all labelled rows, gives the score.

Defined results: documents without any term of the examples (null and empty texts too) have no direction
and get the share of toxic ones among such examples, or among all labels if there is none; equal cosines go
to the smaller example id; without examples of both labels the score is the share of label 1 (0 if there is
no label). A null id is scored and never an example; repeated rows are scored each, and an id with several
texts is the example of the smallest. Ids keep their type; columns beyond id and text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from citeweave.llm.common import array_total, ddl, stored
from citeweave.llm.textops import ranges, row_sums

PER_CLASS = 2000
SAMPLE_BYTES = 1 << 24  # of the examples' texts, per label
FLOOR = 0.5
NEIGHBOURS = 15
BLOCK = 128
COMMON = 0.05
PILOTS = 48
ENTRIES = 1 << 16  # terms of documents that are searched at once
_TERM = re.compile(r"[^\W_]+")


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


class Vectors(NamedTuple):
    """Sparse rows: ``term[first[i]:first[i + 1]]`` and their weights."""

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def rows(self, chosen: np.ndarray) -> Vectors:
        size = np.diff(self.first)[chosen]
        at = ranges(self.first[chosen], size)
        return Vectors(np.append(0, np.cumsum(size)), self.term[at], self.weight[at])


class BlockMaxIndex:
    """Postings of the examples by term and block, with their maxima, and exact top-k search.

    Terms in at least ``COMMON`` of the examples have full postings, one weight per example; they are added
    up by matrix products. Both kinds bound a block by its maxima.
    """

    def __init__(self, examples: Vectors, size: int, block: int = BLOCK, pilots: int = PILOTS) -> None:
        self.block, self.count = block, len(examples.first) - 1
        self.names = np.arange(self.count)  # example number at each place
        if pilots and self.count > block:
            near = BlockMaxIndex(examples.rows(np.linspace(0, self.count - 1, pilots).astype(np.int64)), size, pilots, 0)
            self.names = np.lexsort((self.names, near.search(examples, 1)[1][:, 0]))
            examples = examples.rows(self.names)
        self.blocks = -(-self.count // block)
        place = np.repeat(np.arange(self.count), np.diff(examples.first))
        common = np.flatnonzero(np.bincount(examples.term, minlength=size) >= max(2, COMMON * self.count))
        self.column = np.full(size, -1)
        self.column[common] = np.arange(len(common))
        full = self.column[examples.term] >= 0
        self.full = np.zeros((len(common), self.blocks * block))
        self.full[self.column[examples.term[full]], place[full]] = examples.weight[full]
        self.full_top = self.full.reshape(len(common), self.blocks, block).max(axis=2, initial=0.0)
        term, place, weight = examples.term[~full], place[~full], examples.weight[~full]
        order = np.lexsort((place, term))
        self.place, self.weight = (place % block)[order], weight[order]
        cell = (term * self.blocks + place // block)[order]
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        self.start = np.append(start, len(cell))  # postings of each (term, block)
        self.top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.of = cell[start] % self.blocks if len(start) else start
        self.first = np.searchsorted(cell[start], np.arange(size + 1) * self.blocks)  # (term, block) cells of each term

    def search(self, queries: Vectors, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the k nearest examples with a positive cosine, best first, then zeros and
        ``count``; ``own`` is left out of its row."""
        rows = len(queries.first) - 1
        best, who = np.zeros((rows, k)), np.full((rows, k), self.count, np.int64)
        owner = np.repeat(np.arange(rows), np.diff(queries.first))
        column = self.column[queries.term]
        wide = column >= 0
        dense = np.zeros((rows, len(self.full)))
        dense[owner[wide], column[wide]] = queries.weight[wide]
        term = queries.term[~wide]
        cells = np.diff(self.first)[term]
        cell = ranges(self.first[term], cells)
        weight = np.repeat(queries.weight[~wide], cells)
        row = np.repeat(owner[~wide], cells)
        block = self.of[cell]
        bounds = np.bincount(row * self.blocks + block, weight * self.top[cell], rows * self.blocks)
        bounds = bounds.reshape(rows, self.blocks) + dense @ self.full_top
        favourite = bounds.argmax(axis=1) if rows and self.blocks else np.zeros(rows, np.int64)
        order = np.argsort(block.astype(np.int16) if self.blocks < 1 << 15 else block, kind="stable")
        cell, weight, row = cell[order], weight[order], row[order]
        edge = np.searchsorted(block[order], np.arange(self.blocks + 1))
        for early in (True, False):
            for b in range(self.blocks):
                open_ = (favourite == b) == early
                open_ &= (bounds[:, b] > 0) & (bounds[:, b] + 1e-9 >= best[:, -1])
                live = np.flatnonzero(open_)
                if not len(live):
                    continue
                mine = edge[b] + np.flatnonzero(open_[row[edge[b] : edge[b + 1]]])
                local = (np.cumsum(open_) - 1)[row[mine]]
                size = self.start[cell[mine] + 1] - self.start[cell[mine]]
                at = ranges(self.start[cell[mine]], size)
                target = np.repeat(local * self.block, size) + self.place[at]
                cosine = np.bincount(target, np.repeat(weight[mine], size) * self.weight[at], len(live) * self.block)
                places = slice(b * self.block, (b + 1) * self.block)
                cosine = np.round(cosine.reshape(len(live), self.block) + dense[live] @ self.full[:, places], 12)
                held = self.names[places]
                names = np.append(held, np.full(self.block - len(held), self.count))
                if own is not None:
                    cosine[names == own[live][:, None]] = 0.0
                better = (cosine.max(axis=1) > 0) & (cosine.max(axis=1) >= best[live, -1])
                live, cosine = live[better], cosine[better]
                names = np.where(cosine > 0, names, self.count)
                all_cosines, all_names = np.hstack([best[live], cosine]), np.hstack([who[live], names])
                first = np.lexsort((all_names, -all_cosines), axis=1)[:, :k]
                best[live] = np.take_along_axis(all_cosines, first, 1)
                who[live] = np.take_along_axis(all_names, first, 1)
        return best, who


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    importance: np.ndarray  # idf times what the term says about the label
    ids: list
    labels: np.ndarray
    index: BlockMaxIndex | None
    curve: tuple[float, float]
    silent: float  # score of texts without a term of the examples
    k: int

    def weigh(self, first: np.ndarray, term: np.ndarray, times: np.ndarray) -> Vectors:
        weight = (1 + np.log(np.maximum(times, 1))) * self.importance[term]
        norm = np.sqrt(row_sums(weight**2, first))
        return Vectors(first, term, weight / np.repeat(np.where(norm > 0, norm, 1), np.diff(first)))

    def vote(self, cosines: np.ndarray, who: np.ndarray) -> np.ndarray:
        trust = np.where(cosines > 0, 1 / (1.05 - np.minimum(cosines, 1)), 0)
        says = np.append(self.labels, 0)[who]
        return (trust * says).sum(axis=1) / np.maximum(trust.sum(axis=1), 1e-12)

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * votes + self.curve[1])))


def _counted(texts: Iterable[str | None], vocabulary: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row boundaries, term numbers, counts) for runs of texts with some ``ENTRIES`` known terms."""
    low, first, term, times = 0, [0], [], []
    for text in texts:
        for name, n in Counter(terms(text)).items():
            at = vocabulary.get(name)
            if at is not None:
                term.append(at)
                times.append(n)
        first.append(len(term))
        if len(term) >= ENTRIES:
            yield low, np.array(first), np.array(term, np.int64), np.array(times)
            low, first, term, times = low + len(first) - 1, [0], [], []
    if len(first) > 1:
        yield low, np.array(first), np.array(term, np.int64), np.array(times, np.int64)


def _curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of the label on the vote (Newton, ridge against separation)."""
    z, at = np.stack([votes, np.ones(len(votes))], axis=1), np.zeros(2)
    weights = weights / weights.sum() * len(weights)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ at)))
        gradient = z.T @ (weights * (p - labels)) + 1e-2 * at
        step = np.linalg.solve((z * (weights * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), gradient)
        at = at - step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 0.0)), float(at[1])


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS,
    sample_bytes: int = SAMPLE_BYTES, floor: float = FLOOR, k: int = NEIGHBOURS,
) -> Model:
    """Learn from ``labels(key, y)``, one row per id."""
    spark = docs.sparkSession
    counts = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    alone = Model({}, np.zeros(0), [], np.zeros(0), None, (0.0, 0.0), float(share), k)
    chosen = [
        r for y in (0, 1) for r in labels.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class).collect()
    ]
    sample = spark.createDataFrame([(r.key, r.y, i) for i, r in enumerate(chosen)], "key {}, y int, turn int".format(
        labels.schema["key"].dataType.simpleString()))
    examples = stored(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(F.broadcast(sample), "key").groupBy("key", "y", "turn").agg(F.min("text").alias("text"))
    )
    taken, used = [], {0: 0, 1: 0}
    for r in sorted(examples.select("turn", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()):
        used[r.y] += r.size
        if used[r.y] <= sample_bytes:
            taken.append(r.turn)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms(t)) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [*batch.columns[:2], pa.array([list(c) for c in counted], pa.list_(pa.string())),
                 pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))], ["key", "y", "terms", "times"],
            )

    kind = examples.schema["key"].dataType.simpleString()
    rows = (
        examples.where(F.col("turn").isin(taken)).select("key", "y", "text")
        .mapInArrow(listed, f"key {kind}, y int, terms array<string>, times array<bigint>").toArrow().sort_by("key")
    )
    ids, y = rows["key"].to_pylist(), np.array(rows["y"].to_pylist(), np.int64)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return alone
    lists = rows["terms"].combine_chunks()
    names = lists.flatten().dictionary_encode()
    vocabulary = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
    if not vocabulary:
        return alone
    first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    term = names.indices.to_numpy().astype(np.int64)
    times = rows["times"].combine_chunks().flatten().to_numpy()

    def frequencies(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(len(vocabulary) + 1)
        total[-1] = batch.num_rows
        for _, _, held, _ in _counted(batch.column(0).to_pylist(), vocabulary):
            total[:-1] += np.bincount(held, minlength=len(vocabulary))
        return total

    counted = array_total(docs.select(F.col(text).alias("text")), len(vocabulary) + 1, frequencies, 1 << 16)
    idf = np.log((counted[-1] + 1) / (counted[:-1] + 1)) + 1e-6
    a = np.bincount(term[np.repeat(y == 1, np.diff(first))], minlength=len(vocabulary)).astype(float)
    held = np.bincount(term, minlength=len(vocabulary)).astype(float)
    n = float(n1 + n0)
    chi = n * (a * n0 - (held - a) * n1) ** 2 / np.maximum(held * (n - held) * n1 * n0, 1)
    balance = np.where(y == 1, counts.get(1, 0) / n1, counts.get(0, 0) / n0)
    spoken = np.flatnonzero(np.diff(first) > 0)
    mute = np.diff(first) == 0
    silent = float((balance * y)[mute].sum() / balance[mute].sum()) if mute.any() else float(share)
    blank = Model(vocabulary, idf * (floor + chi), [ids[i] for i in spoken], y[spoken], None, (0.0, 0.0), silent, k)
    vectors = blank.weigh(first, term, times).rows(spoken)
    index = BlockMaxIndex(vectors, len(vocabulary))
    votes = np.zeros(len(spoken))
    for low in range(0, len(spoken), BLOCK):
        part = np.arange(low, min(low + BLOCK, len(spoken)))
        votes[part] = blank.vote(*index.search(vectors.rows(part), k, own=part))
    return replace(blank, index=index, curve=_curve(votes, y[spoken], balance[spoken]))


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text", evidence: int = 3) -> DataFrame:
    """``keep`` columns plus score and ``evidence``: ids, labels and cosines of the nearest examples."""
    kept = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)
    id_kind = pa.array(model.ids).type if model.ids else pa.int64()
    id_name = from_arrow_type(id_kind).simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, m.silent)
            proof: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            texts = batch.column(len(names)).to_pylist() if m.index is not None else []
            for low, first, term, times in _counted(texts, m.vocabulary):
                said = np.flatnonzero(np.diff(first) > 0)
                if not len(said):
                    continue
                cosines, who = m.index.search(m.weigh(first, term, times).rows(said), m.k)
                scores[low + said] = m.score(m.vote(cosines, who))
                for i, c, w in zip((low + said).tolist(), cosines.tolist(), who.tolist(), strict=True):
                    proof[i] = [
                        {"example": m.ids[j], "label": int(m.labels[j]), "cosine": x}
                        for x, j in zip(c[:evidence], w[:evidence], strict=True) if x > 0
                    ]
            kind = pa.list_(pa.struct([("example", id_kind), ("label", pa.int32()), ("cosine", pa.float64())]))
            yield pa.record_batch(
                [*batch.columns[: len(names)], pa.array(scores), pa.array(proof, kind)], [*names, "score", "evidence"]
            )

    return kept.mapInArrow(
        judge, ddl(kept, "score double", f"evidence array<struct<example:{id_name},label:int,cosine:double>>")
    )
