"""Merkle manifest of a table: digests, inclusion proofs and their check after tampering.

Time-forward processing. Nodes are labelled by (tree, level, place), children before parents. A node's digest is
a message to its parent; a queue ordered by label hands every node the messages of its children, in their order.
Between tasks the queue is Spark's external sort by label: a task owns a run of 16**3 leaves, which shares three levels of
parents, and sends one message, the run's digest, to the next round. Inside a task it is a heap. A second sweep goes
through the labels backwards: a node hands each child the siblings above it, so a leaf ends with its proof.
Only one row per run travels between rounds, and rounds grow with the logarithm of the largest tree.

Defined results: null columns enter the leaf as ``-``; rows of a tree with a null id come first, equal ids are ordered
by leaf digest, and fully equal rows by their place in the input, which changes no digest. A null id is never
tampered with. A null source has its own tree, before all others. Columns besides the five are not read. An
empty table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import stored
from citeweave.llm.ranks import numbered

FAN = 16
STEPS = 3  # levels that one task handles
RUN = FAN**STEPS


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as byte count, colon and text, or a dash for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_of(nodes: int) -> int:
    """Levels until one of ``nodes`` remains."""
    count = 0
    while nodes > 1:
        nodes, count = -(-nodes // FAN), count + 1
    return count


def sweep(digests: list[str], steps: int) -> list[list[str]]:
    """Digests of a run by level, from its leaves up; a queue ordered by node label delivers them to the parents."""
    levels = [list(digests)] + [[] for _ in range(steps)]
    queue = [(1, place // FAN, place, d) for place, d in enumerate(digests)] if steps else []
    while queue:
        level, node = queue[0][:2]
        inputs = []
        while queue and queue[0][:2] == (level, node):
            inputs.append(heapq.heappop(queue)[3])
        made = digest("".join(inputs))
        levels[level].append(made)
        if level < steps:
            heapq.heappush(queue, (level + 1, node // FAN, node, made))
    return levels


def unsweep(levels: list[list[str]], path: list[str]) -> Iterator[list[str]]:
    """For each leaf of a run its path: siblings before and after the node, level by level. ``path`` is that of the
    run's top node; every node extends it for its children."""
    held = [path]
    for nodes in reversed(levels[:-1]):
        below = []
        for start in range(0, len(nodes), FAN):
            run = nodes[start : start + FAN]
            for at in range(len(run)):
                below.append(["".join(run[:at]), "".join(run[at + 1 :]), *held[start // FAN]])
        held = below
    yield from held


def fold(start: str, path: list[str]) -> str:
    """The root that a leaf digest and its path give."""
    for before, after in zip(path[::2], path[1::2]):
        start = digest(before + start + after)
    return start


def _runs(nodes: DataFrame) -> DataFrame:
    """(tree, place, total, digest): one node per run of the given ones. The group is the run, so at most ``RUN`` rows."""

    def rise(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        total = int(frame["total"].iloc[0])
        steps = min(STEPS, levels_of(total))
        top = sweep(list(frame["digest"]), steps)[-1][0]
        return pd.DataFrame({
            "tree": frame["tree"].iloc[:1], "place": [int(frame["place"].iloc[0]) // RUN], "total": [-(-total // RUN)], "digest": [top],
        })

    run = (F.col("place") / RUN).cast("bigint")
    return nodes.groupBy("tree", run.alias("run")).applyInPandas(rise, "tree string, place bigint, total bigint, digest string")


def _paths(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(tree, place, path) of ``nodes`` from (tree, place, path) of their runs' top nodes."""

    def sink(frame: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        levels = sweep(list(frame["digest"]), min(STEPS, levels_of(int(frame["total"].iloc[0]))))
        paths = list(unsweep(levels, list(top["path"].iloc[0])))
        return pd.DataFrame({"tree": frame["tree"].to_numpy(), "place": frame["place"].to_numpy(), "path": paths})

    run = (F.col("place") / RUN).cast("bigint")
    return nodes.groupBy("tree", run.alias("run")).cogroup(
        tops.groupBy("tree", F.col("place").alias("run"))
    ).applyInPandas(sink, "tree string, place bigint, path array<string>")


def _rounds(leaves: DataFrame) -> list[DataFrame]:
    """Node tables from the leaves to one node per tree; the largest tree sets their number."""
    largest = leaves.agg(F.max("total")).first()[0] or 0
    tables = [leaves]
    while largest > 1:
        tables.append(stored(_runs(tables[-1])))
        largest = -(-largest // RUN)
    return tables


def _descend(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the lowest of ``tables``, given those of the one node of each tree in the highest."""
    for nodes in reversed(tables[:-1]):
        paths = stored(_paths(nodes.select("tree", "place", "total", "digest"), paths))
    return paths


def manifest(
    docs: DataFrame, key: str = "doc_id", tree: str = "source", lang: str = "lang", size: str = "n_chars", text: str = "text"
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), one row per document."""
    tampered = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    head = [F.col(c) for c in (key, tree, lang, size)]
    changed = F.translate(F.col(text), ascii_uppercase, ascii_lowercase)
    own = leaf(*head, F.col(text))
    rows = stored(docs.select(
        F.col(key).alias("key"), F.coalesce(F.concat(F.lit("+"), F.col(tree)), F.lit("")).alias("tree"), own.alias("digest"),
        F.when(tampered & (changed != F.col(text)), leaf(*head, changed)).otherwise(own).alias("seen"),
    ))
    leaves = stored(
        numbered(rows, "tree", ["key", "digest"], "number", "total").withColumn("place", F.col("number") - 1).drop("number")
    )
    tables = _rounds(leaves)
    subroots = tables[-1].select(F.col("tree").alias("of"), F.lit("").alias("tree"), F.col("digest"))
    roots = stored(
        numbered(stored(subroots), "tree", ["of"], "number", "total").withColumn("place", F.col("number") - 1).drop("number")
    )
    above = _rounds(roots)
    top = above[-1].first()
    root = top.digest if top else ""
    start = above[-1].select("tree", "place", F.array().cast("array<string>").alias("path"))
    over = _descend(above, start).join(roots.select("place", "of", F.col("digest").alias("subroot")), "place")
    over = stored(over.select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("place"), "path", "subroot"))
    paths = _descend(tables[1:], over.select("tree", "place", "path")) if len(tables) > 1 else over
    runs = stored(paths.select("tree", "place", "path").join(over.select("tree", "subroot"), "tree"))

    def check(frame: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        levels = sweep(list(frame["digest"]), min(STEPS, levels_of(int(frame["total"].iloc[0]))))
        proofs = list(unsweep(levels, list(run["path"].iloc[0])))
        folded = [fold(d, p) for d, p in zip(frame["seen"], proofs)]
        return pd.DataFrame({
            "key": frame["key"].to_numpy(), "leaf": frame["digest"].to_numpy(), "subroot": run["subroot"].iloc[0], "root": root,
            "proof_sha256": [digest("".join(p)) for p in proofs], "folded_root": folded, "verified": [f == root for f in folded],
        })

    place = (F.col("place") / RUN).cast("bigint")
    kind = docs.schema[key].dataType.simpleString()
    texts = leaves.withColumn("key", F.col("key").cast("string"))  # pandas has no null among whole numbers
    checked = texts.groupBy("tree", place.alias("run")).cogroup(runs.groupBy("tree", F.col("place").alias("run"))).applyInPandas(
        check, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return checked.select(F.col("key").cast(kind).alias(key), *checked.columns[1:])
