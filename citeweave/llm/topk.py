"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector of d components is cut into 1, 4, 16 segments. With the mean m and deviation s of a
segment of length l, the squared distance of two vectors is at least the sum over segments of
``l * ((m1 - m2)**2 + (s1 - s2)**2)``, and finer cuts give larger bounds. As ``2 q.x = |q|**2 +
|x|**2 - distance**2``, a lower bound of the distance is an upper bound of the product. A block of
queries is compared with a block of vectors coarse to fine: pairs whose bound falls below the
query's k-th best product so far leave, and only survivors are multiplied out, in 64-bit integers
or, where the largest components of two blocks could leave 64 bits on the way, in Python's.

Queries and vectors are dealt into blocks whose number follows their counts; every query block
meets every vector block in its own task. A task returns at most k rows per query, so neither side
is broadcast and no pair table exists.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of
different length are never compared, vectors without components have product 0; equal products go to
the smaller id, repeated ids are separate rows. A scaled component or a product of a pair that is
multiplied out beyond 64 bits has no place in the result's type and ends the job with an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.scale import top_k

QUERY_BLOCK = 1024
VECTOR_BLOCK = 16384
STEP = 2048
NONE = 1 - (1 << 63)  # below every product, and its negative fits


def integers(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long; null for a vector that takes no part."""
    wide = F.raise_error(F.lit("a vector has a component beyond 64 bits after scaling"))
    sound = F.forall(
        F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    cells = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    return F.when(sound, F.transform(cells, lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(wide)))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products along the last axis; an error where one leaves 64 bits."""
    limit = left.shape[-1] * float(np.abs(left.astype(np.float64)).max(initial=0)) * float(
        np.abs(right.astype(np.float64)).max(initial=0)
    )
    if limit < 2.0**62:
        return np.einsum("...d,...d->...", left, right)
    exact = (left.astype(object) * right.astype(object)).sum(axis=-1)
    if any(abs(x) >= -NONE for x in exact.ravel()):
        raise OverflowError("an inner product leaves 64 bits")
    return exact.astype(np.int64)


def levels(dimension: int) -> list[np.ndarray]:
    """Segment borders from coarse to fine."""
    out, parts = [], 1
    while parts * 2 <= dimension and parts <= 16:
        out.append(np.linspace(0, dimension, parts + 1).astype(int))
        parts *= 4
    return out


def statistics(vectors: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Means and deviations of the segments, each scaled by the root of the segment's length."""
    lengths = np.diff(borders)
    values = vectors.astype(np.float64)
    means = np.add.reduceat(values, borders[:-1], axis=1) / lengths
    squares = np.add.reduceat(values**2, borders[:-1], axis=1) / lengths
    deviations = np.sqrt(np.maximum(squares - means**2, 0))
    return np.hstack([means, deviations]) * np.sqrt(np.tile(lengths, 2))


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query id, vector id, product) of the k best vectors of this block for each query."""
    dimension = queries.shape[1]
    scores = np.full((len(queries), k), NONE)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    cuts = levels(dimension)
    mine = [statistics(queries, c) for c in cuts]
    for low in range(0, len(vectors), STEP):
        part, part_ids = vectors[low : low + STEP], ids[low : low + STEP]
        theirs = [statistics(part, c) for c in cuts]
        if cuts:
            bound = mine[0] @ theirs[0].T  # half of |q|^2 + |x|^2 - (lower bound of the distance)^2
        else:
            bound = np.full((len(queries), len(part)), np.inf)
        slack = 1e-6 * np.abs(bound).max(initial=0.0) + 1.0 if cuts else 0.0
        kth = scores[:, -1].astype(np.float64)
        # With no k-th product yet, the best k by the coarse bound are multiplied out first.
        if low == 0 and len(part) > k and cuts:
            seeds = np.argpartition(-bound, k, axis=1)[:, : k + 1]
            first = np.stack([products(queries, part[s]) for s in seeds.T], axis=1)
            first[part_ids[seeds] == query_ids[:, None]] = NONE
            kth = np.maximum(kth, np.sort(first, axis=1)[:, -k].astype(np.float64))
        rows, columns = np.nonzero((bound + slack >= kth[:, None]) & (part_ids[None, :] != query_ids[:, None]))
        for own, other in zip(mine[1:], theirs[1:], strict=True):
            keep = []
            for at in range(0, len(rows), 1 << 17):
                r, c = rows[at : at + (1 << 17)], columns[at : at + (1 << 17)]
                keep.append(np.einsum("pf,pf->p", own[r], other[c]) + slack >= kth[r])
            stay = np.concatenate(keep) if keep else np.zeros(0, bool)
            rows, columns = rows[stay], columns[stay]
        exact = np.zeros(len(rows), np.int64)
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            exact[at : at + (1 << 16)] = products(queries[r], part[c])
        stay = exact >= kth[rows]
        rows, exact, found = rows[stay], exact[stay], part_ids[columns[stay]]
        order = np.lexsort((found, -exact, rows))
        rows, exact, found = rows[order], exact[order], found[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, exact, found, place = (x[place < k] for x in (rows, exact, found, place))
        new_scores = np.full_like(scores, NONE)
        new_names = np.full_like(names, np.iinfo(np.int64).max)
        new_scores[rows, place], new_names[rows, place] = exact, found
        scores, names = np.hstack([scores, new_scores]), np.hstack([names, new_names])
        order = np.lexsort((names, -scores), axis=1)[:, :k]
        scores, names = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
    filled = names != np.iinfo(np.int64).max
    return [
        (int(query_ids[q]), int(names[q, j]), int(scores[q, j])) for q, j in zip(*np.nonzero(filled), strict=True)
    ]


def search(
    queries: DataFrame, vectors: DataFrame, k: int, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest products; a query never finds its own id.

    Both inputs have (id long, v array<long>) with null ``v`` for rows that take no part.
    """
    asked, held = queries.where("v is not null"), vectors.where("v is not null")
    counts = asked.agg(F.count("*").alias("q")).crossJoin(held.agg(F.count("*").alias("n"))).first()
    across, down = max(1, -(-counts.q // query_block)), max(1, -(-counts.n // vector_block))
    sides = [
        asked.select(
            F.size("v").alias("size"), F.pmod(F.xxhash64("id"), F.lit(across)).cast("int").alias("qb"),
            F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("vb"), "id", "v",
        ),
        held.select(
            F.size("v").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("qb"),
            F.pmod(F.xxhash64("id", F.lit(1)), F.lit(down)).cast("int").alias("vb"), "id", "v",
        ),
    ]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = best_of_block(
                left["id"].to_numpy(), np.stack(left["v"].to_list()), right["id"].to_numpy(), np.stack(right["v"].to_list()), k
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    cells = [side.groupBy("size", "qb", "vb") for side in sides]
    best = cells[0].cogroup(cells[1]).applyInPandas(compare, "query_id long, vec_id long, score long")
    return top_k(best, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
