"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortry.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``a, b``).

    In each round a node takes the smallest of itself and its neighbours as its label, edges are rewritten between
    labels, and edges within a label go.  The smallest node of a component keeps its label throughout.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = scratch.keep(both, f"{name}-edges0")
    nodes = scratch.keep(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), f"{name}-nodes0")
    k = 0
    while not both.isEmpty():
        k += 1
        label = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), f"{name}-labels{k}")
        nodes = nodes.join(label, F.col("component") == F.col("a"), "left").select("node", F.coalesce("to", "component").alias("component"))
        nodes = scratch.keep(nodes, f"{name}-nodes{k}")
        left = both.join(label, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        both = left.join(label, "a").select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b").distinct()
        both = scratch.keep(both, f"{name}-edges{k}")
        scratch.drop(f"{name}-labels{k}", f"{name}-edges{k - 1}", f"{name}-nodes{k - 1}")
    return nodes


def extended(found: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``found`` (of ``components``) after further ``links`` (``a, b``), of which only those between components are followed."""
    if links.isEmpty():
        return found
    one = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    across = links.select("a", "b").join(one, "a", "left").join(two, "b", "left")
    across = across.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    across = scratch.keep(across, f"{name}-across")
    if across.isEmpty():
        return found
    moved = components(across, scratch, name)
    # A component's label is its smallest node, so a label that moves is a node of ``found``, or a node that is new.
    to = moved.select(F.col("node").alias("label"), F.col("component").alias("to"))
    old = found.join(to, F.col("component") == F.col("label"), "left").select("node", F.coalesce("to", "component").alias("component"))
    return scratch.keep(old.unionByName(moved.join(found, "node", "left_anti")), f"{name}-extended")
