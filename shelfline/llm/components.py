"""Connected components by contraction: written tables, no link set on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch

# Pointer jumps before each contraction; a path of sorted nodes shrinks by 2^JUMPS a round.
JUMPS = 2


def _relabelled(edges: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its parent; both sides are plain scans, so AQE may split hot nodes."""
    named = parents.select(F.col("node").alias(column), F.col("parent").alias("to"))
    return edges.join(named, column).drop(column).withColumnRenamed("to", column)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); nodes are longs, the root the smallest.

    Every round maps each node to the smallest node within reach and joins what is left of the
    links on those; rounds go with the logarithm of the longest path.  No links give no rows.
    """
    edges = scratch.keep(links.where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    found = None
    while edges.limit(1).count():
        near = edges.select(F.explode(F.array(
            F.struct(F.col("v").alias("node"), F.col("u").alias("parent")),
            F.struct(F.col("u").alias("node"), F.col("u").alias("parent")))).alias("x")).select("x.*")
        parents = scratch.keep(near.groupBy("node").agg(F.min("parent").alias("parent")))
        for _ in range(JUMPS):
            parents = scratch.keep(_relabelled(parents, parents, "parent"))
        found = parents.withColumnRenamed("parent", "root") if found is None else scratch.keep(
            found.join(parents.select(F.col("node").alias("root"), F.col("parent").alias("to")),
                       "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left = _relabelled(_relabelled(edges, parents, "u"), parents, "v").where("u <> v")
        edges = scratch.keep(left.select(F.least("u", "v").alias("u"),
                                         F.greatest("u", "v").alias("v")).distinct())
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found
