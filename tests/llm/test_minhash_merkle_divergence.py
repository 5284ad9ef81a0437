"""MinHash groups, Merkle manifests and divergence audits against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeweave.llm import divergence, graph, merkle, minhash
from citeweave.llm.textops import shingles, slices
from citeweave.session import ship_package

TYPES = "doc_id long, text string, lang string, source string, n_chars long, key string, list long, n int, weight string, leader string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def documents(spark, rows, parts=3):
    """Rows (doc_id, text, lang, source) with the other columns and some whose names clash with internal ones."""
    return spark.createDataFrame(
        [(i, t, g, s, None if t is None else len(t), "k", 7, 1, "w", "l") for i, t, g, s in rows], TYPES
    ).repartition(parts)


# --- MinHash -----------------------------------------------------------------


def word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def plain_groups(rows):
    sets = [(i, word_sets(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            root[find(a)] = find(b)
    least = {}
    for at, (i, _) in enumerate(sets):
        r = find(at)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[find(at)]) for at, (i, s) in enumerate(sets))


def edited_copies(seed, copies=24, length=90):
    """Copies of one text with scattered edits, a passage that many texts share, one-line templates and exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(length)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(length)] = rng.choice(words)
        texts.append(" ".join(text[: rng.choice([length, length, length - 12])]))
    texts += [" ".join([*passage, *(rng.choice(words) for _ in range(rng.randrange(3, 40)))]) for _ in range(copies)]
    texts += [f"user{i} of our site may copy this page with notice only" for i in range(copies)]
    texts += [base and " ".join(base).upper()] * 5 + ["", None, " \n", "one", "ONE", "one two", "x " * 400]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("few", [6, 64])
def test_groups_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW", few)
    rows = edited_copies(few)
    got = minhash.groups(documents(spark, [(i, t, "en", "s") for i, t in rows]))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == plain_groups(rows)


def test_groups_take_null_ids_repeats_and_nothing(spark):
    rows = [(5, "a b c d", None, None), (5, "a b c d", "x", None), (None, "a b c d", None, "s"), (None, "other words here", None, "s"), (7, None, None, None)]
    got = minhash.groups(documents(spark, rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == sorted(
        [(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (7, 0, 7)], key=repr
    )
    assert minhash.groups(documents(spark, []).limit(0)).count() == 0


def test_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for shared in (1000, 850, 500, 0):
        a, b = pool[:1000], np.append(pool[:shared], pool[2000 : 3000 - shared])
        low = minhash.minima(np.append(np.sort(a), np.sort(b)), np.array([0, len(a), len(a) + len(b)]))
        packed = minhash.signatures(low).view(np.int64)
        row = spark.createDataFrame([(packed[0].tolist(), packed[1].tolist())], "x array<bigint>, y array<bigint>")
        seen = row.select(minhash.equal_fields("x", "y").alias("n"), minhash.estimate("x", "y").alias("j")).first()
        fields = [[(int(w) >> s) & 3 for w in p.view(np.uint64) for s in range(0, 64, 2)] for p in packed]
        assert seen.n == sum(u == v for u, v in zip(*fields, strict=True))
        assert abs(seen.j - shared / (len(a) + len(b) - shared)) < 0.17
        met = (minhash.band_keys(low)[0] == minhash.band_keys(low)[1]).sum()
        assert (met == minhash.BANDS) == (shared == 1000) and (met == 0 or shared >= 500)
    assert 150 < minhash.least_equal(85) < 0.8875 * minhash.MINIMA and minhash.least_equal(100) == minhash.MINIMA


def test_minima_of_empty_rows_and_of_long_texts():
    text = " ".join(f"w{i % 5000}" for i in range(400_000))  # above 2 MB
    ((low, high, data, offsets),) = slices(pa.array([text]))
    values, first = shingles(data, offsets, 3)
    assert (low, high) == (0, 1) and len(values) == 5000
    got = minhash.minima(np.append(values, values[:7]), np.array([0, 0, 5000, 5000, 5007]))
    assert not got[:, [0, 2]].any() and (got[:, 1] <= got[:, 3]).all()


# --- Merkle ------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """Root and, for each leaf, the siblings before and after it level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            low = at // 16 * 16
            path.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 16])))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows):
    trees = {}
    for i, text, lang, source in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        size = None if text is None else len(text)
        made = [h("".join(map(part, (i, source, lang, size, t)))) for t in (text, text and text.translate({c: c + 32 for c in range(65, 91)}))]
        touched = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        trees.setdefault("" if source is None else "+" + source, []).append((i, made[0], made[1] if touched else made[0]))
    names = sorted(trees, key=str.encode)
    built = {n: plain_tree([leaf for _, leaf, _ in trees[n]]) for n in names}
    root, above = plain_tree([built[n][0] for n in names])
    out = []
    for n, top in zip(names, above):
        for (i, leaf, seen), path in zip(trees[n], built[n][1]):
            folded = seen
            for before, after in [*path, *top]:
                folded = h(before + folded + after)
            out.append((i, leaf, built[n][0], root, h("".join(b + a for b, a in [*path, *top])), folded, folded == root))
    return sorted(out, key=repr)


def some_rows(counts):
    rows, number = [], 0
    for source, count in counts.items():
        for _ in range(count):
            rows.append((number, [f"Text É {number}", f"small {number}", "", None][number % 4], [None, "en"][number % 2], source))
            number += 3
    return rows


@pytest.mark.parametrize("steps", [1, 3])
def test_manifest_equals_plain_trees(spark, monkeypatch, steps):
    """A hot source, sources of 1, 16 and 17 rows, a null and an empty one; small runs take more rounds."""
    monkeypatch.setattr(merkle, "STEPS", steps)
    monkeypatch.setattr(merkle, "RUN", 16**steps)
    rows = some_rows({"hot": 4500 if steps == 3 else 600, "one": 1, None: 3, "": 2, "sixteen": 16, "seventeen": 17, **{f"s{i}": 1 for i in range(20)}})
    got = sorted((tuple(r) for r in merkle.manifest(documents(spark, rows, 7)).collect()), key=repr)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    alone = [(4, "A", "en", "s")]
    assert [tuple(r) for r in merkle.manifest(documents(spark, alone)).collect()] == plain_manifest(alone)
    rows = [(None, "X", None, None), (None, "X", None, None), (2**60 + 1, "Y" * 3_000_000, "en", "s"), (2**60 + 2, "y", "en", "s"), (9, None, None, "s")]
    assert sorted((tuple(r) for r in merkle.manifest(documents(spark, rows)).collect()), key=repr) == plain_manifest(rows)
    assert merkle.manifest(documents(spark, []).limit(0)).count() == 0


def test_sweeps_are_inverse():
    digests = [h(str(i)) for i in range(300)]
    levels = merkle.sweep(digests, 3)
    assert [len(x) for x in levels] == [300, 19, 2, 1] and levels[3][0] == plain_tree(digests)[0]
    for d, path in zip(digests, merkle.unsweep(levels, ["up", "per"])):
        assert path[-2:] == ["up", "per"] and merkle.fold(d, path[:-2]) == levels[3][0]


# --- divergence --------------------------------------------------------------


def plain_audit(rows):
    langs, docs = {}, {}
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        langs.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        docs.setdefault(lang or "", Counter()).update(set(terms))
    out = []
    for lang, groups in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        whole = sum(groups.values(), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(whole)
        for s, c in groups.items():
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for name, found, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, s, name, item, -value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def worded_rows(seed, count=240):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "Re", "é", "zu", "ﬁx", "日") for b in ("n", "ta", "LO", "ß", "m" * 40)]
    rows = []
    for i in range(count):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "é", "x\ny:1"])
        words = [rng.choice(vocabulary[: 10 + 20 * (source == "hot")]) for _ in range(rng.randrange(0, 30))]
        rows.append((i, rng.choice([None, "", "7 !"]) if rng.random() < 0.1 else rng.choice([" ", "-1_", "\n"]).join(words), lang, source))
    return rows + [(9000, "lonely words", "fr", "z"), (9001, "no kept term", "it", "p"), (9002, "at all", "it", "q"), (9003, None, "it", "r")]


@pytest.mark.parametrize("span,cells", [(4, 8), (1 << 12, 1 << 20)])
def test_audit_equals_plain_sums(spark, monkeypatch, span, cells):
    monkeypatch.setattr(divergence, "SPAN", span)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = worded_rows(span)
    got = divergence.audit(documents(spark, rows, 5)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows)
    assert divergence.audit(documents(spark, []).limit(0)).count() == 0


def test_only_200_terms_are_ranked(spark):
    """More terms than ranks, all with the same value: the item decides. A very long text and repeated rows."""
    terms = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(260)]
    rows = [(i, " ".join(terms), "en", "all") for i in range(3)] + [(5, "long " * 500_000, "en", "other"), (6, "long", "en", "other"), (6, "long", "en", "other")]
    got = divergence.audit(documents(spark, rows)).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == plain_audit(rows)
    assert sum(r.part == "term" and r.source == "all" for r in got) == 200


def test_equal_subtrees_are_one_node():
    counts = np.array([[3, 0, 0, 0, 3, 0, 0, 0], [0, 0, 0, 0, 3, 0, 0, 0], [3, 0, 0, 0, 3, 0, 0, 0]])
    leaves, levels, roots = divergence.trees(counts)
    assert leaves.tolist() == [0, 3] and [len(left) for left, _ in levels] == [2, 2, 2] and roots[0] == roots[2] != roots[1]


def test_prices_equal_sums_over_all_terms():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (5, 64))
    counts[:, 50:] = -1
    counts[2, :50] = 0
    sums = np.where(counts > 0, counts, 0).sum(axis=1)
    got = divergence.prices(counts, sums, 50)
    for a, b in itertools.product(range(5), repeat=2):
        p, q = ([1 + 10**9 * (int(c) + 1) // (int(sums[x]) + 50) for c in counts[x, :50]] for x in (a, b))
        assert got[a, b] == sum((u - v) ** 2 // v for u, v in zip(p, q, strict=True))


def test_shares_do_not_overflow(spark):
    pairs = [(0, 1), (1, 3), (10**12, 3 * 10**12 + 7), (9 * 10**13, 9 * 10**13 + 1), (5, 10**13)]
    want = [1 + 10**9 * (c + 1) // t for c, t in pairs]
    count, total = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert divergence.share(count, total).tolist() == want
    table = spark.createDataFrame(pairs, "c long, t long").coalesce(1)
    assert [r[0] for r in table.select(divergence.share_column(F.col("c"), F.col("t"))).collect()] == want


def test_minhash_plans_no_groups_where_every_list_is_short(spark):
    rows = spark.createDataFrame([(l, k, 10, k) for l in (1, 2) for k in range(3 * l)], "list bigint, key bigint, n int, weight bigint")
    short, stars = minhash._stars(rows, 6)
    assert short.count() == 9 and stars is None
    short, stars = minhash._stars(rows, 3)
    assert short.count() == 3 and sorted(r.key for r in stars.collect()) == [0, 1, 2, 3, 4]


def test_minhash_rounds_store_little(spark, monkeypatch):
    """Each step that is stored adds jobs and shuffles, of which the driver and the disk keep records."""
    monkeypatch.setattr(minhash, "FEW", 6)
    compared, steps = [], []
    compare, stored = minhash._compare, minhash.stored
    monkeypatch.setattr(minhash, "_compare", lambda *a: compared.append(1) or compare(*a))
    monkeypatch.setattr(minhash, "stored", lambda df: steps.append(1) or stored(df))
    rows = edited_copies(6)
    got = minhash.groups(documents(spark, [(i, t, "en", "s") for i, t in rows]))
    assert len(compared) == 2 and len(steps) <= 20
    assert sorted(tuple(r) for r in got.collect()) == plain_groups(rows)


def test_minhash_stores_no_lists_of_one_member(spark, monkeypatch):
    kept, stored = [], minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    rows = [(k, k, 10, k) for k in range(50)] + [(7, 70, 10, 1), (7, 71, 10, 2)]
    short, stars = minhash._stars(spark.createDataFrame(rows, "list bigint, key bigint, n int, weight bigint"), 6)
    assert sorted(r.key for r in short.collect()) == [7, 70, 71] and stars is None
    assert [df.count() for df in kept] == [1]


def test_no_side_of_a_join_goes_through_the_driver(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else rng.choice(words) for w in base[i % 6].split())) for i in range(90)]
    plans, store = [], minhash.stored

    def stored(df):
        out = store(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(minhash, "stored", stored)
    monkeypatch.setattr(graph, "stored", stored)
    found = minhash.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert found.count() == 90
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in plan for plan in plans)
    assert not any("BroadcastExchange" in plan for plan in plans)
