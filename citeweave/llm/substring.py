"""Substring duplicates by relative Lempel-Ziv parsing of word sequences.

The reference is the corpus itself, every document a block. Its index holds the first occurrence
(smallest id, then smallest start) of word windows of the least factor length. A document is parsed
greedily: where a window has an earlier occurrence, a factor begins; it grows as long as the next
window's first occurrence continues the same source. Where that breaks off, the window across the
boundary is looked up itself, so a run of repeated words that comes from two sources loses nothing
in between. The union of the factors is the union of all windows that occur earlier.

Not every window need be indexed. A window of 20 words holds 13 runs of 8 words; the one with the
smallest hash (leftmost first) is its anchor, equal windows have equal anchors at equal places. An
anchor at a single place in the corpus means that none of its windows repeats. Anchors are counted
with task-side and map-side sums; the repeated ones fill a bitmap of fixed size, and only windows
whose anchor is in it reach the index. When very many anchors repeat, the bitmap lets more windows
pass, never fewer: results do not depend on it. Of equal windows in a batch only the first takes part
in the search for the first occurrence; the others know an earlier one, so no window gathers more rows
than there are batches.

Defined results: null, empty and blank texts have no word; a null id takes no part (its text stays
whole and is no source); rows with the same id count as one document; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import stored
from citeweave.llm.textops import mix, slices, windows, words

LEAST = 20
ANCHOR = 8
BITS = 1 << 27
_SALT = np.uint64(0x2545F4914F6CDD1D)


def _slide(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost smallest value in each run of ``span``."""
    place, have = np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(values[a] <= values[b], a, b)
        have += step
    return place


def anchored(data: np.ndarray, offsets: np.ndarray, least: int, anchor: int):
    """(row of the window, start inside the row, window hash, anchor hash, anchor place) of all windows."""
    found = words(data, offsets)
    starts, hashes = windows(found, least)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, hashes, hashes, none
    _, runs = windows(found._replace(rows=np.zeros_like(found.rows)), anchor)  # runs across rows are never chosen
    place = _slide(runs, least - anchor + 1)[starts]
    rows = found.rows[starts]
    return rows, starts - found.first[rows], hashes, runs[place], place


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ _SALT) & np.uint64(BITS - 1)).astype(np.int64)


def _repeated_bits(docs: DataFrame, least: int, anchor: int) -> np.ndarray:
    """Bitmap of the anchors that stand at two places or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in slices(batch.column(0)):
                _, _, _, hashes, place = anchored(data, offsets, least, anchor)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                parts.append(hashes[new])
            if parts:
                hashes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(np.minimum(n, 2), pa.int32())], ["anchor", "n"])

    counted = docs.select("text").mapInArrow(count, "anchor bigint, n int")
    often = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_bit(np.asarray(batch.column(0)).view(np.uint64)) + 1)], ["h"])

    filled = often.mapInArrow(bits, "h bigint").groupBy(F.expr("bitmap_bucket_number(h)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")
    )
    out = np.zeros(BITS // 8, np.uint8)
    for row in filled.toLocalIterator():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """(key, start, source, source_start): every window that occurs earlier, with its first occurrence.

    ``start`` counts words. The source of a window is the first place of the same words in the corpus.
    """
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    shared = docs.sparkSession.sparkContext.broadcast(_repeated_bits(named, least, anchor))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            keys = np.asarray(batch.column(0))
            rank = np.unique(keys, return_inverse=True)[1]
            parts = []
            for low, _, data, offsets in slices(batch.column(1)):
                rows, starts, hashes, anchors, _ = anchored(data, offsets, least, anchor)
                bit = _bit(anchors)
                some = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                parts.append((rows[some] + low, starts[some], hashes[some]))
            if not parts:
                continue
            rows, starts, hashes = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((starts, rank[rows], hashes))
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[order][1:] != hashes[order][:-1]
            origin = np.empty(len(hashes), np.int64)
            origin[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
            first = origin == np.arange(len(hashes))
            # Later occurrences know an earlier one already: any key will do to deal them out evenly. Rows stay in
            # the documents' order, in which ids and starts compress well.
            dealt = np.where(first, hashes, mix(np.arange(len(hashes), dtype=np.uint64) >> np.uint64(8)))
            names = batch.column(0)
            yield pa.record_batch(
                [
                    pa.array(dealt.view(np.int64)), names.take(pa.array(rows)), pa.array(starts, pa.int32()),
                    names.take(pa.array(rows[origin], mask=first)), pa.array(starts[origin], pa.int32(), mask=first),
                ],
                ["window", "key", "start", "source", "source_start"],
            )

    kind = named.schema["key"].dataType.simpleString()
    rows = named.mapInArrow(look, f"window bigint, key {kind}, start int, source {kind}, source_start int")
    place = F.struct("key", "start")
    earliest = F.min(F.when(F.col("source").isNull(), place)).over(Window.partitionBy("window"))
    source = F.when(F.col("source").isNull(), earliest).otherwise(
        F.struct(F.col("source").alias("key"), F.col("source_start").alias("start"))
    )
    return rows.withColumn("earliest", source).where(place != F.col("earliest")).select(
        "key", "start", F.col("earliest.key").alias("source"), F.col("earliest.start").alias("source_start")
    )


def factors(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """(key, factors): arrays of (start, length) in words, one row per document that repeats something."""
    found = matches(docs, key, text, least, anchor)
    # Windows of one factor agree in their source and its distance; 32 bits of both and the start fit a long.
    line = F.xxhash64("source", F.col("source_start") - F.col("start")).bitwiseAND(F.lit(0xFFFFFFFF))
    packed = F.shiftleft(F.col("start").cast("bigint"), 32).bitwiseOR(line)
    grouped = found.groupBy("key").agg(F.collect_list(packed).alias("at"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1):
                values = np.sort(np.asarray(row.values))
                starts, lines = values >> 32, values & 0xFFFFFFFF
                breaks = np.flatnonzero((np.diff(starts) != 1) | (np.diff(lines) != 0))
                begin, end = np.append(0, breaks + 1), np.append(breaks, len(starts) - 1)
                out.append(
                    [{"start": s, "length": n} for s, n in zip(
                        starts[begin].tolist(), (starts[end] - starts[begin] + least).tolist(), strict=True
                    )]
                )
            listed = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            yield pa.record_batch([batch.column(0), pa.array(out, listed)], ["key", "factors"])

    kind = grouped.schema["key"].dataType.simpleString()
    return grouped.mapInArrow(parse, f"key {kind}, factors array<struct<start:int,length:int>>")


def remove(
    docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", kept_text: bool = False
) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept]) of every document after cutting its factors out."""
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(found, "key", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            totals, removed, digests, kept = [], [], [], []
            for value, found_ in zip(texts, spans, strict=True):
                parts = value.encode().split() if value else []
                totals.append(len(parts))
                if found_:
                    edge = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(edge, [f["start"] for f in found_], 1)
                    np.add.at(edge, [f["start"] + f["length"] for f in found_], -1)
                    parts = list(compress(parts, (np.cumsum(edge)[:-1] == 0).tolist()))
                removed.append(totals[-1] - len(parts))
                whole = b" ".join(parts)
                digests.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole.decode() if kept_text else None)
            out = [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch(
                [*out, *([pa.array(kept, pa.string())] if kept_text else [])],
                ["key", "n_words", "n_removed", "kept_sha256", *(["kept"] if kept_text else [])],
            )

    kind = joined.schema["key"].dataType.simpleString()
    more = ", kept string" if kept_text else ""
    done = joined.select("key", "text", "factors").mapInArrow(
        cut, f"key {kind}, n_words bigint, n_removed bigint, kept_sha256 string{more}"
    )
    return done.withColumnRenamed("key", key)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """Factor every document against the corpus and cut the factors out; factors are stored in between."""
    return remove(docs, stored(factors(docs, key, text)), key, text, kept_text)
