"""Document-disjoint split: linked examples stay on one side.

Components come from alternating large-star and small-star rounds over the
edge table (Kiveris et al., "Connected Components in MapReduce and Beyond").
Minima go back to their rows over salted keys (``scale.with_group_values``), so a
document shared by a third of all examples does not concentrate work. Lineage
is cut by ``checkpoint()``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from citeweave.functions.hashing import leading_fraction, stable_fraction
from citeweave.operators.scale import running_totals, with_group_values
from citeweave.session import ensure_checkpoint_dir

FRACTION_BUCKETS = 4096
PIECE = 1 << 16


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    placed = with_group_values(both, "u", ["v"], {"m": (F.min("v"), F.min)})
    return placed.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    placed = with_group_values(down, "u", ["v"], {"m": (F.min("v"), F.min)})
    # A node and each larger neighbour both point to the smallest one; the node itself comes with its row ``v = m``.
    ends = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return placed.select(ends.alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, maximum_rounds: int = 40) -> DataFrame:
    """Smallest reachable node per node, for edges ``(u, v)`` of one type."""
    ensure_checkpoint_dir(edges.sparkSession)
    current = edges.where("u <> v").select("u", "v").distinct().checkpoint()
    signature = None
    for _ in range(maximum_rounds):
        current = _small_star(_large_star(current)).checkpoint()
        row = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(row) == signature:
            break
        signature = tuple(row)
    else:
        raise RuntimeError("components did not converge within the round limit")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _padded(links: DataFrame, name: Column) -> Column:
    """Integer ids get leading zeros so that text order is their order; other ids stay as they are."""
    if isinstance(links.schema["example_id"].dataType, IntegralType):
        return F.lpad(name.cast("string"), 19, "0")
    return name.cast("string")


def example_components(links: DataFrame) -> DataFrame:
    """Component per example for ``links(example_id, document_id)``.

    A document ties all its examples to the smallest of them, so the graph only
    has example nodes and documents of one example add nothing. The component is
    named after its smallest example.
    """
    pairs = links.select("example_id", "document_id").distinct()
    shared = with_group_values(
        pairs, "document_id", ["example_id"], {"v": (F.min("example_id"), F.min), "n": (F.count("*"), F.sum)}
    ).where("n > 1")
    found = components(shared.select(F.col("example_id").alias("u"), "v"))
    return links.select("example_id").distinct().join(
        found.withColumnRenamed("node", "example_id"), "example_id", "left"
    ).select(
        "example_id",
        F.concat(F.lit("e"), _padded(links, F.coalesce("component", "example_id"))).alias("component"),
    )


def document_order(links: DataFrame, members: DataFrame, seed: int) -> DataFrame:
    """(component, fraction, component_key): the place of a component by its sorted, comma-joined document ids.

    The ids of all components are sorted over all tasks and joined to pieces there. One task then feeds the
    pieces of a component to SHA-256, one after the other, so the joined text never exists as a whole, however
    many documents a component has. No document is in two components, so the first id with its comma orders
    components of equal fraction as the whole texts would. Rows without document id are left out.
    """
    def join_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted ids as comma-joined pieces (component, part, piece, text) of ``PIECE`` characters or a little more."""
        part, number = TaskContext.get().partitionId(), 0
        owner, held, size = None, [], 0
        for frame in batches:
            out = []
            for component, text in zip(frame["component"], frame["text"]):
                if held and (component != owner or size >= PIECE):
                    out.append((owner, part, number, ",".join(held)))
                    held, size, number = [], 0, number + 1
                owner = component
                held.append(text)
                size += len(text) + 1
            if out:
                yield pd.DataFrame(out, columns=["component", "part", "piece", "text"])
        if held:
            yield pd.DataFrame([(owner, part, number, ",".join(held))], columns=["component", "part", "piece", "text"])

    held = links.join(members, "example_id").where("document_id IS NOT NULL").select("component", "document_id").distinct()
    dealt = held.repartitionByRange("component", "document_id").sortWithinPartitions("component", "document_id")
    pieces = dealt.select("component", F.col("document_id").cast("string").alias("text")).mapInPandas(
        join_ids, "component string, part int, piece int, text string"
    )

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, state, first = None, None, ""
        for frame in batches:
            out = []
            for component, text in zip(frame["component"], frame["text"]):
                if component != owner:
                    if owner is not None:
                        out.append((owner, state.hexdigest(), first))
                    owner, state, first = component, hashlib.sha256(f"{seed}:".encode()), text.split(",", 1)[0] + ","
                    state.update(text.encode())
                else:
                    state.update(f",{text}".encode())
            if out:
                yield pd.DataFrame(out, columns=["component", "digest", "component_key"])
        if owner is not None:
            yield pd.DataFrame([(owner, state.hexdigest(), first)], columns=["component", "digest", "component_key"])

    streams = pieces.repartition("component").sortWithinPartitions("component", "part", "piece")
    found = streams.select("component", "text").mapInPandas(digests, "component string, digest string, component_key string")
    return found.select("component", leading_fraction(F.col("digest")).alias("fraction"), "component_key")


def split(members: DataFrame, dev_fraction: float, seed: int, order: DataFrame | None = None) -> DataFrame:
    """Assign whole components to train or dev.

    ``members(example_id, component)``. Components are ordered by ``order(component, fraction, component_key)``, see
    ``document_order``, or else by a keyed hash of their name; dev is the prefix whose size is closest to the target
    (the shorter prefix on a tie), never empty and never everything.
    """
    if not 0.0 <= dev_fraction <= 1.0:
        raise ValueError("dev_fraction must be between 0 and 1")
    if dev_fraction in (0.0, 1.0):
        side = "train" if dev_fraction == 0.0 else "dev"
        return members.withColumn("side", F.lit(side))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    if order is None:
        sizes = sizes.withColumn("component_key", F.col("component")).withColumn(
            "fraction", stable_fraction(seed, F.col("component_key"))
        )
    else:  # a component without documents has the empty text as its key
        sizes = sizes.join(order, "component", "left").select(
            "component", "n", F.coalesce("component_key", F.lit("")).alias("component_key"),
            F.coalesce("fraction", stable_fraction(seed, F.lit(""))).alias("fraction"),
        )
    sizes = sizes.withColumn("bucket", F.floor(F.col("fraction") * FRACTION_BUCKETS))
    placed = running_totals(
        sizes, [], "bucket", [F.col("fraction"), F.col("component_key"), F.col("component")],
        {"cumulative": F.col("n"), "prefix": F.lit(1).cast("bigint")},
    )
    totals = sizes.agg(F.sum("n").alias("examples"), F.count("*").alias("components"))
    examples, count = totals.select("examples").scalar(), totals.select("components").scalar()
    target = F.greatest(F.lit(1), F.least(examples - 1, F.bround(examples * F.lit(dev_fraction)).cast("bigint")))
    best = placed.where(F.col("prefix") < count).agg(
        F.min_by("prefix", F.struct(F.abs(F.col("cumulative") - target), F.col("prefix"))).alias("best")
    )
    sides = placed.select(
        "component",
        F.when(F.col("prefix") <= F.coalesce(best.scalar(), F.lit(0)), "dev").otherwise("train").alias("side"),
    )
    return members.join(sides, "component").select("example_id", "component", "side")
