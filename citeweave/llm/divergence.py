"""Audit of how the sources of a language differ in their words.

Counts per (language, source, term) come from one pass over the texts. The kept terms of a language (in at least
``LEAST`` of its documents) are numbered by falling count, so that rare terms, whose counts are alike, are
neighbours. Every group's counts are the leaves of a segment tree over the term ids. Trees are hash-consed: equal
subtrees of counts, in any group and at any place, are one node. Two groups are compared by going down both trees at
once from the roots; equal node pairs are merged, with their number as weight, before they go further, so a pair is
opened once and at the leaves each pair of counts is priced once.

The term ids are cut into spans of whole subtrees; a task builds and compares the subtrees of all groups of a language
over one span, and prices are added over spans. A span has ``SPAN`` terms, fewer where a language has so many
sources that they would exceed ``CELLS`` counts. All arithmetic is on whole numbers of 64 bits; shares are divided in two steps
so that counts up to 9e13 cannot overflow.

Defined results: null text, language and source are ''; rows with the same id are documents of their own; a group without terms
has count 0 for every kept term; a language without kept terms gives pairs of value 0 and no term; a language with
one source gives no pair; other columns are not read; an empty table gives no row. Terms are told apart by a hash
of 64 bits inside a slice of text, by their letters afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import stored
from citeweave.llm.ranks import numbered
from citeweave.llm.textops import ranges, slices, words
from citeweave.operators.scale import top_k, with_group_values

LEAST = 3  # documents of the language that hold a kept term
TOP = 200
SPAN = 1 << 12
CELLS = 1 << 20
SLICE = 1 << 20
SCALE_HIGH, SCALE_LOW = 100_000, 10_000  # their product is the scale of shares
_TERM = np.full(256, 0x20, np.uint8)  # letters and bytes beyond ASCII stay, A-Z become small, the rest is blank
_TERM[128:] = np.arange(128, 256)
_TERM[97:123] = np.arange(97, 123)
_TERM[65:91] = np.arange(97, 123)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total)."""
    high = (count + 1) * SCALE_HIGH
    return 1 + high // total * SCALE_LOW + high % total * SCALE_LOW // total


def _div(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right)


def share_column(count: Column, total: Column) -> Column:
    """``share`` of two long columns."""
    high = (count + 1) * SCALE_HIGH
    return 1 + _div(high, total) * SCALE_LOW + _div((high % total) * SCALE_LOW, total)


def _counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) added up; a row with an empty term for every group that occurs.

    Rows are added under one text: length of the language, language, source, line end, term. A term has no line end.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            codes, heads = np.asarray(groups.indices), groups.dictionary

            def rows(code: np.ndarray, terms: pa.Array, counts: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
                keys = pc.binary_join_element_wise(heads.take(pa.array(code)), terms, "\n")
                return pa.record_batch([keys, pa.array(counts, pa.int64()), pa.array(held, pa.int64())], ["key", "count", "docs"])

            none = np.zeros(len(heads), np.int64)
            yield rows(np.arange(len(heads)), pa.array([""] * len(heads), pa.string()), none, none)
            for low, high, data, offsets in slices(batch.column(1), SLICE):
                data = _TERM[data]
                found = words(data, offsets)
                if not len(found.starts):
                    continue
                code = codes[low:high][found.rows]
                order = np.lexsort((found.rows, found.hashes, code))
                code, hashes, row = code[order], found.hashes[order], found.rows[order]
                new = np.append(True, (code[1:] != code[:-1]) | (hashes[1:] != hashes[:-1]))
                new_row = new | np.append(True, row[1:] != row[:-1])
                first = np.flatnonzero(new)
                at = order[first]
                lengths = found.ends[at] - found.starts[at]
                ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
                letters = data[ranges(found.starts[at], lengths)]
                terms = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(letters))
                yield rows(code[first], terms, np.diff(np.append(first, len(order))), np.add.reduceat(new_row.astype(np.int64), first))

    head = F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source")
    found = texts.select(head.alias("head"), "text").mapInArrow(count, "key string, count bigint, docs bigint")
    added = found.groupBy("key").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = F.substring_index("key", "\n", -1)
    size = F.substring_index("key", ":", 1)
    names = F.substring("key", F.length(size) + 2, F.length("key") - F.length(term) - F.length(size) - 2)
    return added.select(names.alias("names"), size.cast("int").alias("size"), term.alias("term"), "count", "docs").select(
        F.substring("names", F.lit(1), F.col("size")).alias("lang"), F.substring("names", F.col("size") + 1, F.length("names")).alias("source"),
        "term", "count", "docs",
    )


def trees(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hash-consed segment trees of the rows of ``counts`` (a power of two of columns).

    Gives the count of each leaf node, the two children of each node level by level upwards, and the root of each row.
    Equal subtrees have one number wherever they stand."""
    leaves, nodes = np.unique(counts, return_inverse=True)
    nodes = nodes.reshape(counts.shape)
    levels = []
    while nodes.shape[1] > 1:
        width = int(nodes.max()) + 1
        pairs, above = np.unique(nodes[:, ::2] * width + nodes[:, 1::2], return_inverse=True)
        levels.append((pairs // width, pairs % width))
        nodes = above.reshape(len(nodes), -1)
    return leaves, levels, nodes[:, 0]


def _merged(pair: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int):
    """Equal (pair, x, y) as one, with the sum of their weights."""
    keys, at = np.unique((pair * width + x) * width + y, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, weight)
    return keys // (width * width), keys // width % width, keys % width, total


def prices(counts: np.ndarray, sums: np.ndarray, kept: int) -> np.ndarray:
    """f summed over the columns of ``counts`` for every ordered pair of rows; -1 marks columns without term."""
    sources = len(counts)
    leaves, levels, roots = trees(counts)
    out = np.zeros((sources, sources), np.int64)
    step = max(1, 2 * CELLS // (sources * counts.shape[1]))
    for low in range(0, sources, step):
        some = np.arange(low, min(low + step, sources))
        pair = (some[:, None] * sources + np.arange(sources)[None, :]).ravel()
        weight = np.ones(len(pair), np.int64)
        x, y = roots[pair // sources], roots[pair % sources]
        for left, right in reversed(levels):
            pair, weight = np.tile(pair, 2), np.tile(weight, 2)
            x, y = np.append(left[x], right[x]), np.append(left[y], right[y])
            pair, x, y, weight = _merged(pair - low * sources, x, y, weight, int(max(x.max(), y.max())) + 1)
            pair = pair + low * sources
        held = leaves[x] >= 0
        pair, weight, a, b = pair[held], weight[held], leaves[x[held]], leaves[y[held]]
        p, q = share(a, sums[pair // sources] + kept), share(b, sums[pair % sources] + kept)
        np.add.at(out.reshape(-1), pair, weight * ((p - q) * (p - q) // q))
    return out


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources of a language, and each source's telling terms."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = stored(_counts(texts))
    found = counts.where("term <> ''")
    terms = stored(
        found.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= LEAST).select("lang", "term", "total", (-F.col("total")).alias("rare"))
    )
    whole = {"words": (F.sum("total"), F.sum)}
    placed = stored(
        with_group_values(numbered(terms, "lang", ["rare", "term"], "number", "kept"), "lang", ["term"], whole)
        .select("lang", "term", "total", (F.col("number") - 1).alias("id"), "kept", "words")
    )
    kept = stored(found.select("lang", "source", "term", "count").join(placed, ["lang", "term"]))
    langs = placed.groupBy("lang").agg(F.max("kept").alias("kept"))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("sum"))
    groups = stored(
        counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("sum", F.lit(0)).alias("sum"), F.coalesce("kept", F.lit(0)).alias("kept"))
    )
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    span = 1 << max(0, min(SPAN.bit_length() - 1, (CELLS // most).bit_length() - 1))
    pairs = _pairs(kept, groups, span)
    order = [F.col("value").desc(), F.col("item")]
    telling = _telling(kept)
    return top_k(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"), ["lang", "source"], order, 2**31 - 1).unionByName(
        top_k(telling.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"), ["lang", "source"], order, TOP)
    )


def _pairs(kept: DataFrame, groups: DataFrame, span: int) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language. Every group takes part in all spans."""
    spans = F.sequence(F.lit(0).cast("bigint"), (F.greatest(F.col("kept") - 1, F.lit(0)) / span).cast("bigint"))
    rows = groups.select("lang", F.explode(spans).alias("span"), "source", F.lit(-1).cast("bigint").alias("id"), F.col("sum").alias("count"), "kept")
    rows = rows.unionByName(kept.select("lang", (F.col("id") / span).cast("bigint").alias("span"), "source", "id", "count", "kept"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        heads = frame[frame["id"] < 0].sort_values("source")
        names, sums, total = heads["source"].to_numpy(), heads["count"].to_numpy(), int(heads["kept"].iloc[0])
        start = int(frame["span"].iloc[0]) * span
        width = min(span, total - start)
        value = np.zeros((len(names), len(names)), np.int64)
        if width > 0 and len(names) > 1:
            table = np.full((len(names), 1 << (width - 1).bit_length()), -1, np.int64)
            table[:, :width] = 0
            body = frame[frame["id"] >= 0]
            row = {name: i for i, name in enumerate(names)}
            table[body["source"].map(row).to_numpy(np.int64), body["id"].to_numpy() - start] = body["count"].to_numpy()
            value = prices(table, sums, total)
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "source": names[a], "item": names[b], "value": value[a, b]})

    partial = rows.groupBy("lang", "span").applyInPandas(compare, "lang string, source string, item string, value bigint")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _telling(kept: DataFrame) -> DataFrame:
    """(lang, source, term, value) of terms with a larger share in the group than in its language."""
    group = F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source")
    summed = with_group_values(kept.withColumn("group", group), "group", ["term"], {"sum": (F.sum("count"), F.sum)})
    p, q = F.col("p"), F.col("q")
    return summed.select(
        "lang", "source", "term", share_column(F.col("count"), F.col("sum") + F.col("kept")).alias("p"),
        share_column(F.col("total"), F.col("words") + F.col("kept")).alias("q"),
    ).where(p > q).select("lang", "source", "term", _div((p - q) * (p - q), q).alias("value"))
