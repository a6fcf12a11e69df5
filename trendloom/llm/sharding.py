"""Sharding by a hierarchical weighted hash tree.

A document descends from the root through regions and racks to a shard. At every node each child
draws ``-ln(u) / weight``, u being a hash of the document's id and the child's name, and the
smallest draw wins. A draw depends on nothing but the id, the child and its weight, so changing a
weight moves documents only into or out of the child whose weight changed; what stays outside
that child keeps its place. Weights of inner nodes are the sums of their shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import whole_text

#: Runs of a shard's rows that are numbered apart from each other.
SLICES = 512
#: Equal rows written out by one task.
RUN = 100_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; ``shard`` is set on leaves only."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def layout(shards: int, racks: int = 2, per_rack: int = 2, settled: int = 8) -> Node:
    """Tree of equal shards: ``settled`` of them in racks and regions, every further one a region
    of its own, so that one more shard takes documents into itself and moves no others."""
    leaf = [Node(f"shard{s}", shard=s) for s in range(shards)]
    base = leaf[: min(settled, shards)]
    rack = [Node(f"rack{i // per_rack}", tuple(base[i : i + per_rack])) for i in range(0, len(base), per_rack)]
    region = [Node(f"region{i // racks}", tuple(rack[i : i + racks])) for i in range(0, len(rack), racks)]
    added = [Node(f"region-of-{x.name}", (Node(f"rack-of-{x.name}", (x,)),)) for x in leaf[len(base) :]]
    return Node("root", (*region, *added))


def _draw(key: Column, node: Node) -> Column:
    # The upper 53 bits of the hash, as a number in (0, 1].
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11) + 1) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard reached from ``node``: the draws of each level pick the subtree to go on in."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    best = F.least(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children)])
    chosen = best["child"]
    reached = F.when(chosen == 0, descend(key, node.children[0]))
    for i, c in enumerate(node.children[1:], 1):
        reached = reached.when(chosen == i, descend(key, c))
    return reached


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Columns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per document.

    The id alone decides (a missing id is a value like any other), so the law is ``key``; equal
    texts with different ids may part. ``slot`` numbers the rows of a shard from 0 without gaps:
    rows that are equal in all columns shown are counted first, slices of a shard are numbered
    apart and moved by the totals of the slices before, and equal rows are written out at last.
    Slots follow the hash of the id, so a repeated task finds the same numbers.
    """
    text = whole_text()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        descend(key, layout(shards)).cast("int").alias("shard"),
        descend(key, layout(shards + 1)).cast("int").alias("grown_shard"),
    )
    shown = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    counted = rows.groupBy(*shown).agg(F.count(F.lit(1)).alias("n"))
    sliced = counted.withColumn("slice", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "size", "text_crc32"), F.lit(SLICES)))
    # At most shards x SLICES rows; their running totals come from one window per shard.
    totals = sliced.groupBy("shard", "slice").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sliced.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = numbered.join(F.broadcast(starts), ["shard", "slice"]).withColumn("first", F.col("start") + F.col("ahead"))
    runs = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    one = runs.withColumn("k", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + RUN, F.col("n")) - 1)))
    return one.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("k")).alias("slot"), "grown_shard",
    )
