"""Sharding: a hierarchical weighted hash tree over regions, racks and shards.

A row descends the tree from the root. At each node every child draws a number from
the row's key and the child's name, ``-ln(u) / weight``; the smallest draw wins. A
child's weight is the sum of the weights below it. When a weight changes, only draws of
the nodes on its path change, so rows move only into or out of subtrees whose weight
changed; a new shard with a subtree of its own takes rows only into itself.

Defined cases: a null key draws like the empty string; a null text has no bytes and the
checksum of no bytes; equal rows go to one shard and get different slots; an empty table
gives no rows; columns of the input other than those named are carried by ``assign``
and not read by ``number_slots``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.llm.common import Shared


@dataclass(frozen=True)
class Node:
    """A subtree, or a shard where ``shard`` is set."""

    name: str
    children: Sequence[Node] = field(default_factory=tuple)
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return self.own_weight if self.shard is not None else sum(c.weight for c in self.children)


def even_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Node:
    """Regions of racks of shards, numbered in order, every shard of weight 1."""
    racks = [
        Node(f"rack-{first // shards_per_rack}",
             [Node(f"shard-{s}", shard=s) for s in range(first, min(first + shards_per_rack, shards))])
        for first in range(0, shards, shards_per_rack)
    ]
    regions = [
        Node(f"region-{first // racks_per_region}", racks[first:first + racks_per_region])
        for first in range(0, len(racks), racks_per_region)
    ]
    return Node("root", regions)


def grow(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard, in a region of its own."""
    leaf = Node(f"shard-{shard}", shard=shard, own_weight=weight)
    region = Node(f"region-of-{shard}", [Node(f"rack-of-{shard}", [leaf])])
    return Node(tree.name, [*tree.children, region])


def _uniform(key: Column, name: str) -> Column:
    """A number inside (0, 1) from the key and a node's name: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(name + "/"), key).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def shard_of(tree: Node, key: Column) -> Column:
    """The shard number a key descends to."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def descend(node: Node) -> Column:
        if node.shard is not None:
            return F.lit(node.shard)
        if len(node.children) == 1:
            return descend(node.children[0])
        draws = [
            F.struct((-F.ln(_uniform(text, c.name)) / F.lit(float(c.weight))).alias("draw"),
                     F.lit(i).alias("child"))
            for i, c in enumerate(node.children) if c.weight > 0
        ]
        won = F.least(*draws).getField("child") if len(draws) > 1 else F.lit(0)
        chosen = F.lit(None).cast("int")
        for i, child in enumerate(node.children):
            chosen = F.when(won == i, descend(child)).otherwise(chosen)
        return chosen

    return descend(tree)


def assign(df: DataFrame, tree: Node, key: str, out: str = "shard") -> DataFrame:
    """``df`` with the column ``out``; an equal named column is replaced."""
    return df.withColumn(out, shard_of(tree, F.col(key)))


def number_slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Gapless places from 0 within each shard.

    Rows are written once with the number of the writing task and their place there.
    Rows per (shard, task) are counted, the counts summed up along the tasks, and only
    the rows of one task and shard are ever numbered together.
    """
    shared = Shared(df.sparkSession)
    marked = shared.save(df.withColumn("_row", F.monotonically_increasing_id()), "slots")
    marked = marked.withColumn("_task", F.shiftright("_row", 33))
    counts = marked.groupBy(shard, "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(shard, "_task").orderBy("_row"))
    return (
        marked.withColumn("_inside", inside)
        .join(offsets, [shard, "_task"])
        .withColumn(slot, F.col("_before") + F.col("_inside") - 1)
        .drop("_row", "_task", "_inside", "_before")
    )
