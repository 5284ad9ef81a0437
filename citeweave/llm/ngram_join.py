"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

A document is the set of its distinct shingles; documents with the same set form one class, and only
one of a class is joined. All shingles have one global order: rare ones first (by a count sketch of
ALL documents that never counts too low), then by hash. For a set of n shingles and threshold t, at
least ``need = ceil(t n)`` of them are in any linked set, so the first ``n - need + l`` shingles
contain the first l common ones: two linked sets share l shingles within their l-prefixes. Every
document chooses its own l: a longer prefix costs more postings, but fewer candidates share l of
them; the sketch estimates both. A pair needs ``min(l1, l2)`` shared shingles, counted in the
prefixes of that l, before its sets are compared exactly. For a pair the sizes tell more: with
``c = t / (1 + t) (n1 + n2)`` common shingles needed, prefixes of ``n - c + l`` do.

Components need not see every link. First each document is compared with two leaders of the postings
it shares (the smallest id and the most central document), which collapses groups of near copies
without listing their pairs; then ALL candidate pairs that still lie in different components are
compared. Links inside a component cannot change it, so the components are exact. Stray members of
a group of copies would meet all others of it; two documents compared with the same centre need
common shingles outside that centre if their parts in common with it are too small to link them,
so they are joined on those instead.

Hot postings: a posting list whose sketch count is below ``COLD`` cannot be longer than that; a list
that may be longer is dealt into parts with a leader each. The members of a list are never paired
as they are: they are grouped by set size and place of the shingle, groups are paired first, and only
groups whose sizes and places leave room for enough common shingles have their members paired. A
shingle that all pages of a template share, each beside words of its own, thus costs its groups.

Defined results: null, empty and blank texts have no shingle and stay alone (component = own id);
with fewer words than ``size`` the whole sequence is the one shingle; repeated rows get the same
component; ids are taken as unique texts, a null id gives the component of its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import stored
from citeweave.llm.graph import components
from citeweave.llm.textops import list_array, mix, ranges, shingles, slices

CELLS = 1 << 20
SLAB = 1 << 12
LONGEST = 6  # largest l
COLD = 1 << 14
CHANCE = 0.02  # partners that a shingle not known to be frequent is expected to have
VERIFY = 60.0  # cost of a comparison in postings
BITS = 1 << 25


def _cell(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(44)).astype(np.int64)


class Sets:
    """What one pass over the documents gives: ``rows`` (key, n, s1, s2) and the sketch."""

    def __init__(self, docs: DataFrame, size: int) -> None:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(CELLS, np.int64)
            for batch in batches:
                for low, high, data, offsets in slices(batch.column(1)):
                    values, first = shingles(data, offsets, size)
                    cells += np.bincount(_cell(values), minlength=CELLS)
                    n = np.diff(first)
                    sums = [
                        np.zeros(len(n), np.uint64) if not len(values) else _wrapping_sums(mix(values ^ np.uint64(c)), first)
                        for c in (0x51ED270B9F1A3C27, 0xA24BAED4963EE407)
                    ]
                    nulls = pa.nulls(high - low, pa.int32()), pa.nulls(high - low, pa.binary())
                    yield pa.record_batch(
                        [
                            batch.column(0).slice(low, high - low), pa.array(n, pa.int64()),
                            *[pa.array(s.view(np.int64)) for s in sums], *nulls, nulls[0],
                        ],
                        names,
                    )
            slabs = range(CELLS // SLAB)
            part = TaskContext.get().partitionId()
            parts = [cells[i * SLAB : (i + 1) * SLAB].astype("<i8").tobytes() for i in slabs]
            missing = [pa.nulls(len(parts), t) for t in (kinds[0], pa.int64(), pa.int64(), pa.int64())]
            yield pa.record_batch(
                [*missing, pa.array(slabs, pa.int32()), pa.array(parts), pa.array([part % 64] * len(parts), pa.int32())], names
            )

        names = ["key", "n", "s1", "s2", "slab", "counts", "part"]
        key = docs.schema["key"].dataType.simpleString()
        kinds = [pa.string() if key == "string" else pa.int32() if key == "int" else pa.int64()]
        passed = stored(
            docs.select("key", "text").mapInArrow(
                count, f"key {key}, n bigint, s1 bigint, s2 bigint, slab int, counts binary, part int"
            )
        )
        self.rows = passed.where("slab is null").select("key", "n", "s1", "s2")

        def add(frame):
            total = np.sum([np.frombuffer(c, "<i8") for c in frame["counts"]], axis=0)
            return frame.iloc[:1].assign(counts=[total.astype("<i8").tobytes()])

        sketch = passed.where("slab is not null").select("slab", "part", "counts")
        kind = "slab int, part int, counts binary"
        summed = sketch.groupBy("slab", "part").applyInPandas(add, kind).groupBy("slab").applyInPandas(add, kind)
        self.sketch = np.zeros(CELLS, np.int64)
        for row in summed.collect():
            self.sketch[row.slab * SLAB : (row.slab + 1) * SLAB] = np.frombuffer(row.counts, "<i8")


def _wrapping_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(first) > 0)
    if len(filled):
        out[filled] = np.add.reduceat(values, first[filled])
    return out


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def prefixes(
    values: np.ndarray, first: np.ndarray, sketch: np.ndarray, usual: float, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens in global order, their sketch counts, row boundaries, l of each row)."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    counts = sketch[_cell(values)]
    excess = np.maximum(counts - usual, 0)
    level = np.where(excess > 4 * np.sqrt(usual) + 8, np.frexp(excess)[1], 0)
    order = np.lexsort((values, level, rows))
    values, counts = values[order], counts[order]
    partners = np.where(level[order] > 0, excess[order], CHANCE)
    base = n - needed(n, percent)
    running = np.append(0, np.cumsum(partners))
    best, chosen = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for ell in range(1, LONGEST + 1):
        length = np.minimum(base + ell, n)
        lists = running[first[:-1] + length] - running[first[:-1]]
        cost = np.where(ell <= np.maximum(needed(n, percent), 1), length + lists * (1 + VERIFY / ell**2), np.inf)
        better = cost < best
        best[better], chosen[better] = cost[better], ell
    length = np.where(n > 0, np.minimum(base + chosen, n), 0)
    at = ranges(first[:-1], length)
    return values[at], counts[at], np.append(0, np.cumsum(length)), chosen


def _postings(docs: DataFrame, keys: DataFrame, sets: Sets, size: int, percent: int) -> DataFrame:
    """(token, key, n, l, at, parts): at is the token's place in the document's order, from 0."""
    usual = float(np.median(sets.sketch))
    shared = docs.sparkSession.sparkContext.broadcast(sets.sketch.astype(np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                values, first = shingles(data, offsets, size)
                tokens, counts, edges, ell = prefixes(values, first, shared.value, usual, percent)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, high - low), pa.array(np.diff(first), pa.int32()), pa.array(ell, pa.int32()),
                        list_array(tokens.view(np.int64), edges, pa.int64()), list_array(counts // COLD + 1, edges, pa.int32()),
                    ],
                    ["key", "n", "l", "tokens", "parts"],
                )

    key = docs.schema["key"].dataType.simpleString()
    rows = docs.select("key", "text").mapInArrow(cut, f"key {key}, n int, l int, tokens array<bigint>, parts array<int>")
    one = rows.join(keys, "key", "left_semi")
    flat = one.select("key", "n", "l", F.posexplode(F.arrays_zip("tokens", "parts")).alias("at", "t"))
    return flat.select(F.col("t.tokens").alias("token"), "key", "n", "l", "at", F.col("t.parts").alias("parts"))


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of tokens that at least two documents hold, with a leader: the list's smallest key.

    A list that the sketch cannot bound by ``COLD`` is dealt into parts by the hash of the key. Each part has its
    leader, and all its postings stay, as their partners may be in another part.
    """
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("key"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    lists = Window.partitionBy("token", "part")
    return postings.select("token", part.alias("part"), "key", "n", "l", "at", "parts").select(
        "token", "key", "n", "l", "at", F.min("key").over(lists).alias("leader"),
        ((F.col("parts") > 1) | (F.min("key").over(lists) < F.max("key").over(lists))).alias("stays"),
    ).where("stays").drop("stays")


class Join:
    def __init__(self, docs: DataFrame, key: str, text: str, size: int, percent: int) -> None:
        self.docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        self.size, self.percent = size, percent

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """(key, v) for the documents in ``pairs``: a bitmap of fixed size keeps most others from being hashed
        and shuffled, the joins that follow are exact."""
        place = F.pmod(F.xxhash64("key"), F.lit(BITS)) + 1  # bitmap buckets begin at value 1
        ids = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        filled = ids.select(place.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("bucket")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")
        )
        wanted = np.zeros(BITS // 8, np.uint8)
        for row in filled.collect():  # at most BITS / 8 bytes
            wanted[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
        shared = self.docs.sparkSession.sparkContext.broadcast(wanted)
        size = self.size

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit, bucket = np.asarray(batch.column(2)), np.asarray(batch.column(3)) - 1
                take = (shared.value[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1
                some = batch.filter(pa.array(take.astype(bool)))
                for low, high, data, offsets in slices(some.column(1)):
                    values, first = shingles(data, offsets, size)
                    yield pa.record_batch(
                        [some.column(0).slice(low, high - low), list_array(values.view(np.int64), first, pa.int64())], ["key", "v"]
                    )

        rows = self.docs.where("key is not null").select("key", "text", place.alias("h")).select(
            "key", "text", F.expr("bitmap_bit_position(h)").alias("bit"), F.expr("bitmap_bucket_number(h)").alias("bucket")
        )
        return rows.mapInArrow(gather, f"key {self.docs.schema['key'].dataType.simpleString()}, v array<bigint>")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb, c, d): sizes of both sets, of the common part, and what b lacks of a."""
        held = stored(self._sets_of(pairs))
        left = pairs.join(held.select(F.col("key").alias("a"), F.col("v").alias("va")), "a")
        both = left.join(held.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
        return both.select(
            *pairs.columns, F.size("va").alias("na"), F.size("vb").alias("nb"), F.array_except("va", "vb").alias("d")
        ).withColumn("c", F.col("na") - F.size("d"))

    def linked(self, compared: DataFrame) -> DataFrame:
        union = F.col("na") + F.col("nb") - F.col("c")
        return compared.where(100 * F.col("c") >= self.percent * union).select("a", "b").distinct()


def _fits(percent: int):
    """Sizes that can reach the threshold."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _common(percent: int) -> Column:
    """Common shingles that sets of na and nb need."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))


def _by_leader(rows: DataFrame, percent: int) -> DataFrame:
    """For each document the leader with which it shares most tokens, if they are enough for a candidate.

    ``rows``: (token, key, n, l, at, leader, ln, ll, lat).
    """
    pairs = rows.where(F.col("key") != F.col("leader")).select(
        F.col("key").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), F.col("ln").alias("nb"),
        F.least("l", "ll").alias("least"), "at", "lat",
    ).where(_fits(percent))
    inside = (F.col("at") < F.col("na") - _common(percent) + F.col("least")) & (
        F.col("lat") < F.col("nb") - _common(percent) + F.col("least")
    )
    counted = pairs.where(inside).groupBy("a", "b", "least").agg(F.count("*").alias("c")).where("c >= least")
    return counted.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def _met(
    rows: DataFrame, lists: list[str], kind: list[str], allowed: Column, carried: list[str], facts: dict[str, Column] | None = None
) -> DataFrame:
    """Pairs (keya, keyb) of different components whose rows share a list, with ``kind`` and ``carried`` of both sides.

    Rows of one list and one ``kind`` form a group. Groups are paired under ``allowed``, a condition on the kinds
    and aggregated ``facts`` of both sides, and members meet only inside paired groups, on the list and both kinds.
    """
    own = {"low": F.min("comp"), "high": F.max("comp"), **(facts or {})}
    groups = stored(rows.groupBy(*lists, *kind).agg(*[v.alias(c) for c, v in own.items()]))
    sides = [groups.select(*lists, *[F.col(c).alias(f"{c}{x}") for c in [*kind, *own]]) for x in "ab"]
    paired = sides[0].join(sides[1], lists).where("lowa < highb").where(allowed).drop(*[f"{c}{x}" for c in own for x in "ab"])
    left, right = [
        rows.select(*lists, *[F.col(c).alias(f"{c}{x}") for c in dict.fromkeys(["key", "comp", *kind, *carried])]) for x in "ab"
    ]
    opened = left.join(stored(paired), [*lists, *[f"{c}a" for c in kind]])
    return opened.join(right, [*lists, *[f"{c}b" for c in kind]]).where("compa < compb")


def _crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components; ``rows``: (token, key, n, l, at, comp, centre, o).

    Two sets with enough in common share a token within the prefixes of l = 1, so pairs are taken from those alone;
    tokens shared in the prefixes of the pair's own l are then counted. Of two documents with the same centre, the
    common part is at most the smaller part in common with the centre and what both hold beside it. Where the former
    does not suffice, ``_beside_centres`` finds the pair.
    """
    mixed = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    rest = stored(rows.join(stored(mixed), "token"))
    open_pair = F.coalesce(
        (F.col("centrea") != F.col("centreb"))
        | ((100 + percent) * F.least("oa", "ob") >= percent * (F.col("na") + F.col("nb"))), F.lit(True)
    )
    first = _fits(percent) & (F.col("ata") <= F.col("na") - _common(percent)) & (
        F.col("atb") <= F.col("nb") - _common(percent)
    )
    head = rest.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    # Groups around one and the same centre meet only where their largest common parts with it leave a pair open.
    one = F.when(F.count("centre") == F.count("*"), F.min("centre"))
    facts = {"one": F.when(one == F.max("centre"), one), "most": F.max("o")}
    apart = F.coalesce(
        (F.col("onea") != F.col("oneb"))
        | ((100 + percent) * F.least("mosta", "mostb") >= percent * (F.col("na") + F.col("nb"))), F.lit(True)
    )
    met = _met(head, ["token"], ["n", "at"], first & apart, ["l", "centre", "o"], facts).where(open_pair)
    pairs = stored(
        met.select(
            F.col("keya").alias("a"), F.col("keyb").alias("b"), F.least("la", "lb").alias("least"),
            *[(F.col(f"n{x}") - _common(percent) + F.least("la", "lb")).cast("int").alias(f"cut{x}") for x in "ab"],
        ).distinct()
    )
    several = pairs.where("least > 1")
    wanted = several.select(F.col("a").alias("key")).union(several.select(F.col("b").alias("key"))).distinct()
    held = stored(rest.join(wanted, "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("at", "token")).alias("p")))
    both = several.join(held.select(F.col("key").alias("a"), F.col("p").alias("pa")), "a").join(
        held.select(F.col("key").alias("b"), F.col("p").alias("pb")), "b"
    )
    inside_a = F.filter("pa", lambda t: t["at"] < F.col("cuta"))["token"]
    inside_b = F.filter("pb", lambda t: t["at"] < F.col("cutb"))["token"]
    enough = both.where(F.size(F.array_intersect(inside_a, inside_b)) >= F.col("least"))
    return pairs.where("least = 1").select("a", "b").union(enough.select("a", "b"))


def _beside_centres(centred: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components with the same centre; ``centred``: (key, n, centre, o, d, comp).

    A pair needs ``s`` common tokens beside the centre. Of its shared tokens, rare ones first, the first common
    one is then among the first ``w - s + 1`` of w on either side.
    """
    flat = centred.select("key", "n", "centre", "o", "comp", F.explode("d").alias("token"))
    mixed = flat.groupBy("centre", "token").agg(
        F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("many")
    ).where("x <> y")
    rest = flat.join(stored(mixed.select("centre", "token", "many")), ["centre", "token"])
    own = Window.partitionBy("key")
    placed = stored(
        rest.withColumn("at", F.row_number().over(own.orderBy("many", "token"))).withColumn("w", F.count("*").over(own))
        .withColumn("behind", F.col("w") - F.col("at"))
    )
    short = F.greatest(F.lit(1), _common(percent) - F.least("oa", "ob"))
    allowed = _fits(percent) & (F.least("behinda", "behindb") + 1 >= short)
    met = _met(placed, ["centre", "token"], ["n", "o", "behind"], allowed, [])
    return met.select(F.col("keya").alias("a"), F.col("keyb").alias("b")).distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id), one row per document."""
    work = Join(docs, key, text, size, percent)
    sets = Sets(work.docs, size)
    filled = sets.rows.where("n > 0")
    classes = stored(filled.groupBy("s1", "s2").agg(F.min("key").alias("rep")))
    keys = classes.where("rep is not null").select(F.col("rep").alias("key"))
    shared = stored(_shared(_postings(work.docs, keys, sets, size, percent)))
    own = [F.col(c).alias(f"l{c}") for c in ("n", "l", "at")]
    head = shared.where("key = leader").select("token", "leader", *own)
    smallest = _by_leader(shared.join(head, ["token", "leader"]), percent)
    # The most central document of a list has the fewest prefix tokens that nobody shares.
    cut = F.least(F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + F.col("l"), F.col("n"))
    lost = stored(shared.groupBy("key").agg((F.count("*") - F.max(cut)).alias("lost")))
    order = F.struct("lost", "key", "n", "l", "at")
    tops = stored(shared.join(lost, "key").groupBy("token").agg(F.max(order).alias("top")).select(
        "token", F.col("top.key").alias("leader"), *[F.col(f"top.{c}").alias(f"l{c}") for c in ("n", "l", "at")]
    ))
    central = _by_leader(shared.drop("leader").join(tops, "token"), percent)
    stars = central.withColumn("central", F.lit(True)).union(smallest.withColumn("central", F.lit(False)))
    compared = stored(work.compare(stored(stars.groupBy("a", "b").agg(F.max("central").alias("central")))))
    links = work.linked(compared)
    near = stored(components(links).select(F.col("id").alias("key"), F.col("component").alias("comp")))
    around = compared.where("central").select(
        F.col("a").alias("key"), F.col("na").alias("n"), F.col("b").alias("centre"), F.col("c").alias("o"), "d"
    )
    place = F.coalesce("comp", "key").alias("comp")
    centred = stored(around.join(near, "key", "left").select("key", "n", "centre", "o", "d", place))
    rows = stored(
        shared.join(centred.select("key", "centre", "o"), "key", "left").join(near, "key", "left")
        .select("token", "key", "n", "l", "at", place, "centre", "o")
    )
    pairs = stored(_crossing(rows, percent).union(_beside_centres(centred, percent)).distinct())
    known = components(stored(links.union(work.linked(work.compare(pairs)))))
    found = classes.join(known.withColumnRenamed("id", "rep"), "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component")
    )
    alone = sets.rows.where("n = 0").select("key", "n", F.col("key").alias("component"))
    placed = filled.join(stored(found), ["s1", "s2"]).select("key", "n", "component")
    return placed.unionByName(alone).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )
