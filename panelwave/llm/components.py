"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.operators.sizing import materialize


def roots(parents: DataFrame) -> DataFrame:
    """(node, label) of a forest given as (node, parent): label is the root above the node. One row for each node.

    Every round doubles how far a node sees, with one join whose sides are dealt by the same key.
    """
    seen = parents.select("node", F.col("parent").alias("label"))
    while True:
        up = seen.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialize(seen.join(up, "label", "left").select(
            "node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")))
        seen = step.drop("moved")
        if step.filter("moved").isEmpty():
            return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node it reaches. Nodes are long.

    Each round hangs all neighbours of a node on the smallest one, first the larger and then the smaller neighbours, so
    the longest path shrinks by a factor and rounds grow with its logarithm. Minima are combined before they are
    shuffled, and a node's edges join one row, so a hub with a third of all edges is split by the skew join. Every
    round's edges are written to the shared folder. Self-loops and null ends are ignored; no edges, no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))  # a null end leaves u = v
    e = materialize(e.filter("u > v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(
            e.select(F.col("v").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        open_ = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
        if open_.filter("leaf > 1 or (leaf > 0 and root > 0)").isEmpty():
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
