"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. A passage is a TF-IDF vector over the words of
the benchmark (others cannot match it) without those in more than ``MAX_SHARE`` of all passages;
frequencies are counted over ALL passages. A randomised SVD finds the leading right singular
vectors: with a random matrix R, one pass over all passages adds up ``A^T (A R)``, whose
orthonormalised columns span them. Items and passages are compared by cosine in that space.

Items are compared in pieces of at most ``STRIDE`` words: wherever such a stretch stands in a
document, one passage holds all of it. A candidate (half of the piece's terms present and a cosine of at
least ``COSINE``, or ``SURE`` of the terms and any cosine) is checked on words, for the whole item: the longest common subsequence of the item and some stretch of at most twice its length, at the passage,
must reach ``LEAST`` of the item; of items under ``SHORT`` words a stretch of their own length must hold all
words in order, but one from 8 words on, so an item of a few words is found where it stands verbatim. That of the item's answer (its last sentence, or a given
column) and the surroundings must reach half of the answer. Paraphrases that keep the order of most words pass, passages with the same topic do not.

The benchmark is handled in blocks of about ``BLOCK`` pieces, each with its own passes, so what is sent to
the tasks has a bound.

Defined results: null and empty texts and items and items with a null id match nothing; an item without any
term in the space is compared on words wherever half of its words occur; repeated rows give one row per id and
item, items that share an id are searched each and the best passage of any stands for the id; documents
with a null id count as one id. Ids keep their type. Equal passages: most common words, then the larger
cosine, then the earlier start.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from citeweave.llm.common import array_total
from citeweave.llm.textops import ranges, raw, row_sums, slices, words

SIZE, STRIDE = 64, 32
RANK = 64
BLOCK = 2000
COUNTED = 1 << 21  # cells of passages and pieces that are counted at once
MAX_SHARE = 0.05
COSINE = 0.2
SURE = 0.8
LEAST = 0.6
ANSWER = 0.5
SHORT = 12


def hashed(text: str) -> np.ndarray:
    data, offsets = raw(pa.array([text]))
    return words(data, offsets, lower=True).hashes


def answer_of(text: str) -> str:
    """The last sentence with a word of a text, the whole text if it is the only one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return parts[-1] if parts else ""


def common_length(a: list[int], places: dict[int, int]) -> int:
    """Length of the longest common subsequence of ``a`` and the sequence whose bit masks are ``places``."""
    row = 0
    for word in a:
        match = places.get(word)
        if match:
            ones = row | match
            row = ones & ~(ones - ((row << 1) | 1))
    return row.bit_count()


def demand(length: int, least: float) -> tuple[int, int]:
    """(words of an item that must stand in order, words of the stretch they may span)."""
    share = math.ceil(least * length - 1e-9)
    return (max(share, length - length // 8), length) if length < SHORT else (share, 2 * length)


def common_in_stretch(region: list[int], places: dict[int, int], stretch: int, least: int) -> int:
    """Longest common subsequence with any ``stretch`` neighbouring words of ``region``, 0 below ``least``."""
    whole = common_length(region, places)
    if whole < least:
        return 0
    if len(region) <= stretch:
        return whole
    shared = [word in places for word in region]
    before = [0, *accumulate(shared)]
    best = least - 1
    for start in compress(range(len(region)), shared):
        if before[min(start + stretch, len(region))] - before[start] > best:
            best = max(best, common_length(region[start : start + stretch], places))
            if best == whole:
                break
    return best if best >= least else 0


def masks(sequence: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(sequence.tolist()):
        out[word] = out.get(word, 0) | (1 << i)
    return out


@dataclass(frozen=True)
class Space:
    vocabulary: np.ndarray  # sorted word hashes
    slots: np.ndarray  # which leading 16 bits occur
    idf: np.ndarray  # 0 for words outside the space
    basis: np.ndarray  # (words, rank)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, word numbers) of the words of the benchmark."""
        at = np.flatnonzero(self.slots[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == hashes[at]
        return at[same], place[same]


def passages(found, space: Space, used: np.ndarray | None):
    """(row and first word of each passage, passage boundaries in the pairs, terms, counts); pairs are distinct."""
    count = np.diff(found.first)
    amount = np.where(count > 0, np.maximum(-(-(count - SIZE) // STRIDE), 0) + 1, 0)
    before = np.append(0, np.cumsum(amount))
    rows = np.repeat(np.arange(len(count)), amount)
    begin = found.first[rows] + (np.arange(before[-1]) - before[rows]) * STRIDE
    at, term = space.ids(found.hashes)
    if used is not None:
        keep = used[term]
        at, term = at[keep], term[keep]
    row = found.rows[at]
    last = (at - found.first[row]) // STRIDE
    keys = []
    for shift in (0, 1):
        number = last - shift
        fits = (number >= 0) & (number < amount[row])
        keys.append((before[row] + number)[fits] * len(space.vocabulary) + term[fits])
    pairs, times = np.unique(np.concatenate(keys), return_counts=True)
    owner, terms = pairs // len(space.vocabulary), pairs % len(space.vocabulary)
    return rows, begin, np.searchsorted(owner, np.arange(before[-1] + 1)), terms, times


def weights(space: Space, edges: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
    """TF-IDF of each pair, passages scaled to length one."""
    value = (1 + np.log(times)) * space.idf[terms]
    norm = np.sqrt(row_sums(value**2, edges))
    return (value / np.repeat(np.where(norm > 0, norm, 1), np.diff(edges))).astype(np.float32)


def _product(value: np.ndarray, dense: np.ndarray, columns: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sparse rows (``value`` at ``columns``, cut by ``edges``) times a dense matrix."""
    out = np.zeros((len(edges) - 1, dense.shape[1]), np.float32)
    filled = np.flatnonzero(np.diff(edges) > 0)
    if len(filled):
        picked = dense[columns]
        picked *= value[:, None]
        out[filled] = np.add.reduceat(picked, edges[filled], axis=0)
    return out


def _fit(docs: DataFrame, items: list[np.ndarray], rank: int, max_share: float) -> Space:
    vocabulary = np.unique(np.concatenate(items))
    slots = np.zeros(1 << 16, bool)
    slots[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    bare = Space(vocabulary, slots, np.zeros(len(vocabulary)), np.zeros((len(vocabulary), 0)))
    size = len(vocabulary)

    def frequencies(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(size + 1)
        for _, _, data, offsets in slices(batch.column(0)):
            _, begin, _, terms, _ = passages(words(data, offsets, lower=True), bare, None)
            total[:size] += np.bincount(terms, minlength=size)
            total[size] += len(begin)
        return total

    counted = array_total(docs.select("text"), size + 1, frequencies)
    df, n = counted[:size], counted[size]
    idf = np.where(df <= max_share * n, np.log((n + 1) / (df + 1)) + 1e-6, 0.0)
    random = np.random.default_rng(7).standard_normal((size, rank)).astype(np.float32)
    weighted = Space(vocabulary, slots, idf, random)
    used = idf > 0

    def power(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((size, rank))
        for _, _, data, offsets in slices(batch.column(0), 1 << 20):
            _, begin, edges, terms, times = passages(words(data, offsets, lower=True), weighted, used)
            if not len(terms):
                continue
            value = weights(weighted, edges, terms, times)
            owner = np.repeat(np.arange(len(begin)), np.diff(edges))
            projected = _product(value, random, terms, edges)
            order = np.argsort(terms, kind="stable")
            first = np.searchsorted(terms[order], np.arange(size + 1))
            total += _product(value[order], projected, owner[order], first)
        return total.ravel()

    summed = array_total(docs.select("text"), size * rank, power).reshape(size, rank)
    basis = np.linalg.qr(summed)[0] if size >= rank and summed.any() else random
    return Space(vocabulary, slots, idf, np.ascontiguousarray(basis, np.float32))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return matrix / np.where(norm > 0, norm, 1)


def pieces(sequence: np.ndarray) -> list[np.ndarray]:
    """Stretches of ``STRIDE`` words that cover an item; the last one ends with it."""
    last = max(len(sequence) - STRIDE, 0)
    return [sequence[s : s + STRIDE] for s in [*range(0, last, STRIDE), last]]


@dataclass(frozen=True)
class Asked:
    """The pieces of a block of items; terms outside the space count only for items that have no other."""

    item: np.ndarray  # item of each piece
    loose: np.ndarray  # no term of its item is in the space
    latent: np.ndarray  # (pieces, rank), length one
    holders: np.ndarray  # pieces, by the terms that they hold
    first: np.ndarray  # where the holders of each term begin
    sure: np.ndarray  # how many make it a candidate whatever its cosine
    enough: np.ndarray  # how many distinct terms of each piece a passage must hold

    def counts(self, owner: np.ndarray, terms: np.ndarray, rows: int) -> np.ndarray:
        """(rows, pieces): how many terms of each piece are among the distinct (owner, term) pairs."""
        times = np.diff(self.first)[terms]
        held = self.holders[ranges(self.first[terms], times)]
        total = np.bincount(np.repeat(owner, times) * len(self.item) + held, minlength=rows * len(self.item))
        return total.reshape(rows, len(self.item))


def _ask(space: Space, items: list[tuple], least: float) -> Asked:
    used = space.idf > 0
    owner, loose, latent, holders, held, sure, enough = [], [], [], [], [], [], []
    for i, (_, sequence, _) in enumerate(items):
        free = not used[space.ids(sequence)[1]].any()
        for piece in pieces(sequence):
            ids, times = np.unique(space.ids(piece)[1], return_counts=True)
            kept = ids if free else ids[used[ids]]
            if not len(kept):
                continue
            holders.append(np.full(len(kept), len(owner)))
            held.append(kept)
            sure.append(math.ceil(SURE * len(kept) - 1e-9))
            # A short item stands whole in one passage, so no more terms than words may be missing.
            missing = len(sequence) - demand(len(sequence), least)[0] if len(sequence) < SHORT else len(kept) // 2
            enough.append(max(1, len(kept) - missing))
            owner.append(i)
            loose.append(free)
            latent.append(((1 + np.log(times)) * space.idf[ids]) @ space.basis[ids])
    terms = np.concatenate(held)
    order = np.argsort(terms, kind="stable")
    first = np.searchsorted(terms[order], np.arange(len(space.vocabulary) + 1))
    return Asked(
        np.array(owner), np.array(loose), _unit(np.array(latent)).astype(np.float32), np.concatenate(holders)[order], first,
        np.array(sure), np.array(enough),
    )


def _retrieve(
    docs: DataFrame, space: Space, items: list[tuple], least: float, cosine: float, item_kind: DataType
) -> DataFrame:
    item_arrow = to_arrow_type(item_kind)
    shared = docs.sparkSession.sparkContext.broadcast((space, items, _ask(space, items, least)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items, asked = shared.value
        use = None if asked.loose.any() else space.idf > 0
        enough = asked.enough
        stride = max(1, COUNTED // len(asked.item))
        checks = [(masks(s), len(s), *demand(len(s), least), masks(a), len(a)) for _, s, a in items]
        for batch in batches:
            out: list[tuple] = []
            for low, _, data, offsets in slices(batch.column(1), 1 << 20):
                found = words(data, offsets, lower=True)
                rows, begin, edges, terms, times = passages(found, space, use)
                if not len(terms):
                    continue
                # Passages with too few terms for any piece cannot pass the check.
                long = np.flatnonzero(np.diff(edges) >= enough.min())
                sizes = np.diff(edges)[long]
                chosen = ranges(edges[long], sizes)
                rows, begin, terms, times = rows[long], begin[long], terms[chosen], times[chosen]
                edges = np.append(0, np.cumsum(sizes))
                if not len(terms):
                    continue
                near = _unit(_product(weights(space, edges, terms, times), space.basis, terms, edges))
                owner = np.repeat(np.arange(len(rows)), sizes)
                pairs: dict[tuple[int, int], float] = {}
                for start in range(0, len(rows), stride):
                    stop = min(start + stride, len(rows))
                    mine = slice(edges[start], edges[stop])
                    counts = asked.counts(owner[mine] - start, terms[mine], stop - start)
                    where, piece = np.nonzero(counts >= enough)
                    alike = np.einsum("pr,pr->p", near[where + start], asked.latent[piece])
                    passed = (alike >= cosine) | (counts[where, piece] >= asked.sure[piece]) | asked.loose[piece]
                    for p, i, c in zip(
                        (where[passed] + start).tolist(), asked.item[piece[passed]].tolist(), alike[passed].tolist(), strict=True
                    ):
                        pairs[p, i] = max(c, pairs.get((p, i), -1.0))
                for (p, i), alike_ in pairs.items():
                    places, length, asked_words, stretch, answer, answer_length = checks[i]
                    row = rows[p]
                    from_ = max(found.first[row], begin[p] - stretch)
                    to = min(found.first[row + 1], begin[p] + SIZE + stretch)
                    region = found.hashes[from_:to].tolist()
                    lcs = common_in_stretch(region, places, stretch, asked_words)
                    if not lcs:
                        continue
                    told = common_length(region, answer)
                    if told >= ANSWER * answer_length:
                        out.append((row + low, items[i][0], int(begin[p] - found.first[row]), alike_, lcs, length, told))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], item_arrow),
                        pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64()),
                        *[pa.array(c, pa.int32()) for c in columns[4:]],
                    ],
                    ["key", "item", "start", "cosine", "common_words", "item_words", "answer_words"],
                )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(
        search,
        f"key {kind}, item {item_kind.simpleString()}, start int, cosine double, common_words int, item_words int, answer_words int",
    )


def find(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", answer: str | None = None, rank: int = RANK, least: float = LEAST, cosine: float = COSINE,
    max_share: float = MAX_SHARE, block: int = BLOCK,
) -> DataFrame:
    """(key, item, start, cosine, common_words, item_words, answer_words): the best passage of every
    document and item that match."""
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    asked = benchmark.select(
        F.col(item).alias("i"), F.col(item_text).alias("t"),
        (F.col(answer) if answer else F.lit(None).cast("string")).alias("a"),
    ).where("i is not null and t is not null").orderBy("i")
    item_kind = asked.schema["i"].dataType
    items = []
    parts: list[DataFrame] = []

    def close() -> None:
        if items:
            space = _fit(named, [s for _, s, _ in items], rank, max_share)
            parts.append(_retrieve(named, space, list(items), least, cosine, item_kind))
            items.clear()

    for row in asked.toLocalIterator():
        sequence = hashed(row.t)
        if len(sequence):
            items.append((row.i, sequence, hashed(row.a if row.a else answer_of(row.t))))
        if sum(-(-len(s) // STRIDE) for _, s, _ in items) >= block:
            close()
    close()
    if not parts:
        kind = named.schema["key"].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"{key} {kind}, {item} {item_kind.simpleString()}, start int, cosine double, common_words int, "
            "item_words int, answer_words int"
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    fields = ["start", "cosine", "common_words", "item_words", "answer_words"]
    best = found.groupBy("key", "item").agg(
        F.max(F.struct("common_words", "cosine", (-F.col("start")).alias("early"), *fields[:1], *fields[3:])).alias("top")
    )
    return best.select(F.col("key").alias(key), F.col("item").alias(item), *[F.col(f"top.{f}").alias(f) for f in fields])
