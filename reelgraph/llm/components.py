"""Connected components of an edge table, by rounds of shuffles.

Every node points to the smallest neighbour label it has seen. A round lets each node's
larger neighbours point to the smallest one (large-star) and shortens the paths
(small-star); the number of rounds grows with the logarithm of the longest path. Only
the number of changed rows reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import Shared


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node each node of an edge can reach."""
    shared = Shared(edges.sparkSession)
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    table = shared.save(pairs.where("u != v").distinct(), "round0")
    number = 0
    while True:
        # Large-star: larger neighbours of a node go to the smallest of all, itself included.
        both = table.select("u", "v").union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = large.distinct()
        # Small-star: smaller neighbours of a node, and itself, go to the smallest of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = lower.withColumnRenamed("u", "w")
        small = large.join(lower, F.col("u") == F.col("w"))
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lower.select(F.col("w").alias("u"), F.col("m").alias("v"))
        )
        number += 1
        fresh = shared.save(small.where("u != v").distinct(), f"round{number}")
        changed = fresh.join(table, ["u", "v"], "left_anti").limit(1).count()
        same_size = not changed and fresh.count() == table.count()
        shared.drop(f"round{number - 1}")
        table = fresh
        if same_size:
            break
    nodes = table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
