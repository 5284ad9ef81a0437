"""Exact cosine top-k for a table of query vectors.

Both paths multiply blocks of vectors inside tasks and emit at most ``k`` rows
per query and task, never all pairs:

* ``broadcast``: the query matrix is measured to be small; each corpus partition
  keeps a running top-k while it streams its batches. The corpus is not shuffled.
  ``streamed`` takes query tables of any size this way, a batch of queries at a time.
* ``grid``: query blocks meet corpus blocks by equi-join key in ``cogroup``;
  a block holds a fixed number of values, whatever the number of queries or
  vectors, and ``cell_rows`` corpus rows of it are multiplied at a time.

``search`` picks one of them by the size of the query table; their results are the same.

A task holds its vectors as matrices, one product of ``QUERY_BLOCK`` queries with
``cell_rows`` vectors, and the candidates that can still reach a query's first ``k``.
Products are made in single precision, whose error has a bound; what comes within the
bound of the first ``k`` is scored in double precision, row by row, so that a score does
not depend on the block it was found in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.scale import fits, top_k
from citeweave.session import stored

BROADCAST_QUERIES = 20_000
CELL_ROWS = 1_024
CORPUS_VALUES, QUERY_VALUES = 4 << 20, 4 << 20  # values of the vectors in a block of the grid or in a batch
CELLS_PER_CORE = 3
QUERY_BLOCK = 256
BATCH_ROWS = 4_096
PENDING = 4  # times k: candidates of a query before they are cut to k
EXACT_VALUES = 1 << 20  # values of the vectors that are scored in double precision at a time
SCORE_DIGITS = 8
MARGIN = 2.0 * 10.0**-SCORE_DIGITS  # scores closer than that may round to the same value


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    if (size == 0).any():
        raise ValueError("zero vector cannot be normalized")
    return matrix / size


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.unique(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError("all vectors must have the same length")
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    return _unit(values.reshape(len(vectors), -1))


def _first(columns: np.ndarray, places: np.ndarray, scores: np.ndarray, k: int):
    """The first ``k`` entries of each column by (score desc, place asc)."""
    order = np.lexsort((places, -scores, columns))
    columns, places, scores = columns[order], places[order], scores[order]
    kept = np.arange(len(columns)) - np.searchsorted(columns, columns) < k
    return columns[kept], places[kept], scores[kept]


def _needed(unit: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the first ``most`` of their copies: copies score alike, so the others reach no first ``k``."""
    odd = np.random.default_rng(7).integers(1, 1 << 62, unit.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    digest = (unit.view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    order = np.argsort(digest, kind="stable")
    start = np.searchsorted(digest[order], digest[order])
    like = (unit[order] == unit[order[start]]).all(axis=1)  # a digest may be that of different vectors
    earlier = np.cumsum(like)
    needed = np.empty(len(unit), bool)
    needed[order] = ~like | (earlier - earlier[start] < most)
    return needed


class _Best:
    """Running top-k of a block of queries over batches of the corpus."""

    def __init__(self, query_ids: pa.Array, matrix: np.ndarray, k: int, exclude_self: bool, tile: int) -> None:
        self.query_ids, self.matrix, self.k, self.exclude_self, self.tile = query_ids, matrix, k, exclude_self, tile
        self.single = matrix.astype(np.float32)
        self.error = (matrix.shape[1] + 4) * 2.0**-23  # of a product in single precision; twice what rounding can add up to
        self.columns, self.ids, self.scores = np.array([], np.int64), None, np.array([])
        self.last = np.full(len(matrix), -np.inf)  # the k-th best score of each full query

    def add(self, ids: pa.Array, unit: np.ndarray) -> None:
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        order = order[np.isfinite(unit).all(axis=1)[order]]  # a vector that is not a number is near nothing
        ids, unit = ids.take(pa.array(order)), unit[order]
        if not self.exclude_self or len(pc.unique(ids)) == len(ids):  # a query's own vectors are one at most
            kept = np.flatnonzero(_needed(unit, self.k + self.exclude_self))
            ids, unit = ids.take(pa.array(kept)), unit[kept]
        spans = self._own(ids) if self.exclude_self else None
        single = unit.astype(np.float32)
        found = [self._block(first, unit, single, spans) for first in range(0, len(self.matrix), QUERY_BLOCK)]
        columns, places, scores = (np.concatenate(parts) for parts in zip(*found, strict=True))
        held = ids.take(pa.array(places))
        if self.ids is not None:
            held = pa.concat_arrays([self.ids, held])
            columns, scores = np.concatenate([self.columns, columns]), np.concatenate([self.scores, scores])
        place = np.empty(len(held), np.int64)
        place[pc.sort_indices(held, null_placement="at_start").to_numpy()] = np.arange(len(held))
        origin = np.argsort(place)
        self.columns, place, self.scores = _first(columns, place, scores, self.k)
        self.ids = held.take(pa.array(origin[place]))
        full = np.flatnonzero(np.bincount(self.columns, minlength=len(self.last)) == self.k)
        self.last[full] = self.scores[np.searchsorted(self.columns, full, side="right") - 1]

    def _own(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For every query the run of sorted ``ids`` that equal its own; null equals nothing."""
        names = pc.unique(ids.drop_null())
        codes = pc.fill_null(pc.index_in(ids, names), -1).to_numpy()
        own = pc.fill_null(pc.index_in(self.query_ids.cast(ids.type), names), -2).to_numpy()
        return np.searchsorted(codes, own), np.searchsorted(codes, own, side="right")

    def _exact(self, columns: np.ndarray, places: np.ndarray, unit: np.ndarray) -> np.ndarray:
        scores, step = np.empty(len(columns)), max(1, EXACT_VALUES // unit.shape[1])
        for low in range(0, len(columns), step):
            part = slice(low, low + step)
            scores[part] = (self.matrix[columns[part]] * unit[places[part]]).sum(axis=1)
        return np.round(np.clip(scores, -1.0, 1.0), SCORE_DIGITS)

    def _block(self, first: int, unit: np.ndarray, single: np.ndarray, spans):
        queries = self.single[first : first + QUERY_BLOCK]
        near = MARGIN + self.error
        floor = self.last[first : first + QUERY_BLOCK] - near
        none = np.array([], np.int64)
        pending, count = [(none, none, np.array([]))], 0
        product = np.empty((len(queries), min(self.tile, len(unit))), np.float32)
        above = np.empty(product.shape, bool)
        for start in range(0, len(unit), self.tile):
            width = min(self.tile, len(unit) - start)
            if width < product.shape[1]:
                product, above = np.empty((len(queries), width), np.float32), np.empty((len(queries), width), bool)
            scores = np.matmul(queries, single[start : start + width].T, out=product)
            if spans is not None:
                low = np.maximum(spans[0][first : first + QUERY_BLOCK] - start, 0)
                high = np.minimum(spans[1][first : first + QUERY_BLOCK] - start, width)
                for row in np.flatnonzero(low < high):
                    scores[row, low[row] : high[row]] = -np.inf
            if width > self.k and np.isneginf(floor).any():
                floor = np.maximum(floor, np.partition(scores, width - self.k, axis=1)[:, width - self.k] - near - self.error)
            # The strict test drops the query's own vector and scores that are not numbers.
            least = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
            at = np.flatnonzero(np.greater(scores, least[:, None], out=above))
            column, place = at // width, at % width + start
            pending.append((column, place, self._exact(column + first, place, unit)))
            count += len(column)
            if count > PENDING * self.k * len(floor) or start + self.tile >= len(unit):
                merged = _first(*(np.concatenate(parts) for parts in zip(*pending, strict=True)), self.k)
                pending, count = [merged], len(merged[0])
                full = np.flatnonzero(np.bincount(merged[0], minlength=len(floor)) == self.k)
                floor[full] = np.maximum(floor[full], merged[2][np.searchsorted(merged[0], full, side="right") - 1] - near)
        column, place, values = pending[0]
        return column + first, place, values

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        queries = self.query_ids.take(pa.array(self.columns))
        return pa.record_batch([queries.cast(schema.types[0]), self.ids.cast(schema.types[1]), pa.array(self.scores)], schema=schema)


def _schema(corpus: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(corpus.dtypes)['chunk_id']}, score double"


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches' rows in tables of about ``CORPUS_VALUES`` values of vectors."""
    held, values = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            piece = batch.slice(start, BATCH_ROWS)
            more = pc.sum(pc.list_value_length(piece.column(1))).as_py()
            if held and values + more > CORPUS_VALUES:
                yield pa.Table.from_batches(held)
                held, values = [], 0
            held.append(piece)
            values += more
    if held:
        yield pa.Table.from_batches(held)


def _shared(queries: DataFrame) -> Broadcast | None:
    """The query table as ids and a matrix; None if it has no row."""
    held = queries.select("query_id", "vector").toArrow()
    if held.num_rows == 0:
        return None
    return queries.sparkSession.sparkContext.broadcast((_flat(held["query_id"]), _matrix(held["vector"])))


def _broadcast_partials(
    corpus: DataFrame, queries: DataFrame, shared: Broadcast | None, k: int, exclude_self: bool, cell_rows: int
) -> DataFrame:
    schema = _schema(corpus, queries)
    if shared is None:
        return corpus.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for block in _blocks(batches):
            best = best or _Best(*shared.value, k, exclude_self, cell_rows)
            best.add(_flat(block.column(0)), _matrix(block.column(1)))
        if best is not None:
            yield best.rows(pa.schema([("query_id", best.query_ids.type), ("chunk_id", best.ids.type), ("score", pa.float64())]))

    return corpus.select("chunk_id", "vector").mapInArrow(run, schema)


def _grid_partials(
    corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool, cell_rows: int
) -> DataFrame:
    n, width = corpus.agg(F.count("*"), F.max(F.size("vector"))).first()
    m, width = queries.count(), max(1, width or 1)
    # Enough blocks to bound a cell's values, and enough query blocks to occupy all cores.
    corpus_blocks = max(1, math.ceil(n * width / CORPUS_VALUES))
    wanted = math.ceil(CELLS_PER_CORE * corpus.sparkSession.sparkContext.defaultParallelism / corpus_blocks)
    query_blocks = max(1, math.ceil(m * width / QUERY_VALUES), min(wanted, math.ceil(m / QUERY_BLOCK)))
    left = corpus.select("chunk_id", "vector").select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(corpus_blocks)).cast("bigint").alias("cb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))).alias("qb"),
        "chunk_id", "vector",
    )
    right = queries.select("query_id", "vector").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(corpus_blocks - 1).cast("bigint"))).alias("cb"),
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("bigint").alias("qb"),
        "query_id", "vector",
    )

    # A task for a cell: cells are few and each holds a lot of work, whatever its bytes.
    tasks = 4 * corpus_blocks * query_blocks
    left, right = left.repartition(tasks, "cb", "qb"), right.repartition(tasks, "cb", "qb")

    def cell(corpus_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        kinds = [("query_id", query_rows["query_id"].type), ("chunk_id", corpus_rows["chunk_id"].type), ("score", pa.float64())]
        if not corpus_rows.num_rows or not query_rows.num_rows:
            return pa.schema(kinds).empty_table()
        best = _Best(_flat(query_rows["query_id"]), _matrix(query_rows["vector"]), k, exclude_self, cell_rows)
        best.add(_flat(corpus_rows["chunk_id"]), _matrix(corpus_rows["vector"]))
        return pa.Table.from_batches([best.rows(pa.schema(kinds))])

    return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(cell, _schema(corpus, queries))


def search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    exclude_self: bool = False,
    max_broadcast_queries: int = BROADCAST_QUERIES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Top ``k`` of ``corpus(chunk_id, vector)`` for ``queries(query_id, vector)``.

    Vectors without direction (zero, empty or null) match nothing; ``undirected`` lists them.
    """
    if not fits(queries.where(_directed()), max_broadcast_queries):
        return gridded(corpus, queries, k, exclude_self, cell_rows)
    corpus, queries = corpus.where(_directed()), queries.where(_directed())
    return _ranked(_broadcast_partials(corpus, queries, _shared(queries), k, exclude_self, cell_rows), k)


def gridded(
    corpus: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = False, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``search`` by the grid, whatever the number of queries."""
    corpus, queries = corpus.where(_directed()), queries.where(_directed())
    return _ranked(_grid_partials(corpus, queries, k, exclude_self, cell_rows), k)


def streamed(
    corpus: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = False, cell_rows: int = CELL_ROWS,
    query_values: int = QUERY_VALUES,
) -> DataFrame:
    """``search`` by broadcasts, whatever the number of queries: the driver holds one batch of them, of about
    ``query_values`` values, and every batch is one pass over the stored corpus."""
    corpus, queries = corpus.where(_directed()), queries.where(_directed())
    m, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    batches = max(1, math.ceil(m * (width or 1) / query_values))
    # The work is the product of both tables, so the corpus is dealt out to all cores, however its files are cut. Shares
    # are alike, and every one gives k rows a query, so there is one for each core.
    dealt = stored(corpus.select("chunk_id", "vector").repartition(corpus.sparkSession.sparkContext.defaultParallelism))
    found = []
    for number in range(batches):
        batch = queries.where(F.pmod(F.xxhash64("query_id", "vector"), F.lit(batches)) == number)
        shared = _shared(batch)
        found.append(stored(_ranked(_broadcast_partials(dealt, batch, shared, k, exclude_self, cell_rows), k)))
        if shared is not None:
            shared.destroy()
    if batches == 1:
        return found[0]
    return _ranked(reduce(DataFrame.unionByName, found).drop("rank"), k)


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    return top_k(partial, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _directed() -> Column:
    return F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))


def undirected(rows: DataFrame, key: str) -> DataFrame:
    """(ref, problem): the rows whose vector is zero, empty or null."""
    return rows.where(~_directed()).select(F.col(key).cast("string").alias("ref"), F.lit("zero_vector").alias("problem"))


def dimension_report(corpus: DataFrame) -> DataFrame:
    """Counts and dimension agreement of a stored index."""
    return corpus.agg(
        F.count("*").alias("vector_count"),
        F.min(F.size("vector")).alias("min_dimension"),
        F.max(F.size("vector")).alias("max_dimension"),
    )
