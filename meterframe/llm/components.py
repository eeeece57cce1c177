"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.shared import checkpointed, hot_join


#: Edges that one task may hold.
FEW = 10_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link to another; root is the least node it reaches.

    ``links`` has long columns u and v; loops, repeats and nulls are ignored. Every round is two grouped minima and two
    joins over a table that never has more rows than the links, and is written to the shared checkpoint folder. The
    centre of a large star is joined by broadcast, so that its links stay spread over all tasks.
    """
    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        sign = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not sign.n or sign == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = sign
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _beside_least(both, 2 * sign.n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _beside_least(large if sign.n < FEW else checkpointed(large), sign.n)
        edges = checkpointed(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _beside_least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): each edge beside the least neighbour of u. So few edges that any task can take all are joined plainly."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return edges.join(least.drop("n"), "u") if rows < FEW else hot_join(edges, checkpointed(least), "u", "n", rows, "v")


def rooted(nodes: DataFrame, parts: DataFrame, node: str) -> DataFrame:
    """(node, n, component_id) of a table (node, n, least): the smallest ``least`` of each component of (node, root)."""
    held = checkpointed(nodes.join(parts.withColumnRenamed("node", node), node, "left").select(node, "n", "least", F.coalesce("root", node).alias("root")))
    found = checkpointed(held.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    return checkpointed(hot_join(held, found, "root", "size", held.count(), node).select(node, "n", "component_id"))
