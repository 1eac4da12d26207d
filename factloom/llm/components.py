"""Connected components of an edge table, by minimum labels and pointer jumping, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import materialize


def _to_least(edges: DataFrame) -> DataFrame:
    """edges (a > b): each node keeps one edge, to its least neighbour below, which takes over its others."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return materialize(moved.union(least.select("a", "least")).distinct(), "cc-edges")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> node, label: the smallest node of each node's component.

    First, twice, a node's edges to smaller nodes are handed to the least of them, so that what many paths connect
    becomes nearly a star. Then each round takes the least label of a node's neighbours and then the label of that label, so chains halve.
    Rounds are written to the shared folder. Loops and repeated edges do no harm; null ends are left out.
    """
    edges = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = _to_least(_to_least(materialize(edges, "cc-edges")))
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        least = labels.join(near, labels.node == near.n).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("to"))
        following = materialize(least.join(jump, F.col("label") == F.col("j"), "left").select("node", "old", F.coalesce(F.least("to", "label"), "label").alias("label")), "cc-labels")
        done = following.where("label != old").isEmpty()
        labels = following.select("node", "label")
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
