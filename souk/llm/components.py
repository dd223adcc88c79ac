"""Connected components of a graph given by its edges, with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of an edge (columns a and b, long).

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by pointer
    jumping, four at once, and draws the edges between these ends, until no edge is left; rounds and
    jumps grow with the logarithm of the nodes. Loops and repeated edges are allowed, nulls are not.
    No edges: no rows.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    edges = edges.where("a < b")
    while edges.take(1):
        both = edges.union(edges.select("b", "a")).toDF("node", "next")
        hooks = written(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("to")))
        jumps = hooks
        while True:
            jumps = written(_jumped(_jumped(jumps)))
            if not jumps.join(hooks.toDF("to", "end"), "to").where("end <> to").take(1):
                break
        labels = written(labels.join(jumps.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        drawn = edges.join(jumps.toDF("a", "to_a"), "a").join(jumps.toDF("b", "to_b"), "b").where("to_a <> to_b")
        edges = written(drawn.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    return labels


def _jumped(hooks: DataFrame) -> DataFrame:
    """node, to: where the hook of the hooked-to node leads."""
    return hooks.join(hooks.toDF("to", "end"), "to").select("node", F.col("end").alias("to"))
