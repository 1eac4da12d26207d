"""Bounded traversal of edge tables: breadth-first levels, hubs, witnesses and frontiers.

A level is one join of the newest nodes with the edges and an anti join with what has been reached; levels are written to
the shared folder. The number of levels is bounded by the caller, so it does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import materialize, release


#: Nodes that are broadcast at most.
FEW = 1_000_000


def _small(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.limit(FEW + 1).count() <= FEW else nodes


def written(edges: DataFrame, unique: bool = False) -> DataFrame:
    """The distinct edges (src, dst) without nulls, as a table that several questions read; edges that are unique are only
    written. What is written already is given back."""
    if "written_edges" in edges.__dict__:
        return edges
    edges = edges.where("src is not null and dst is not null").select("src", "dst")
    out = materialize(edges if unique else edges.distinct(), "edges")
    out.written_edges = True
    return out


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, hubs: DataFrame | None = None) -> DataFrame:
    """edges (src, dst), seeds (node) -> node, depth: the least number of edges from any seed, up to max_depth.

    Nodes in hubs are reached but not expanded, unless they are seeds. Each level is one table; the levels are what the
    result reads. A copy of the edges is released once they are written, `written` edges are left. Edges are moved only for
    a level that starts from more than FEW nodes.
    """
    given, edges = edges, written(edges)
    closed = None if hubs is None else materialize(hubs.select("node"), "bfs-hubs")
    reached = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "bfs")
    newest = reached
    for depth in range(1, max_depth + 1):
        start = newest if closed is None or depth == 1 else materialize(newest.join(_small(closed), "node", "left_anti"), "bfs-start")
        near = edges.join(_small(start.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        found = materialize(near.join(_small(reached.select("node")), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "bfs")
        release(None if start is newest else start)
        newest = found
        if newest.isEmpty():
            release(newest)
            break
        reached = reached.unionByName(newest)
    release(closed, None if edges is given else edges)
    return reached


def hubs(edges: DataFrame, least: int = 8, share: int = 4) -> DataFrame:
    """Nodes with at least max(least, ceil(nodes / share)) distinct callers. edges: caller (src) -> callee (dst).

    Nodes and their callers are counted in one pass over the distinct edges, and written.
    """
    given, edges = edges, written(edges)
    ends = edges.select(F.inline(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).cast("long").alias("one")), F.struct(F.col("src").alias("node"), F.lit(0).cast("long").alias("one")))))
    counted = materialize(ends.groupBy("node").agg(F.sum("one").alias("callers")), "hubs")
    release(None if edges is given else edges)
    limit = max(least, -(-counted.count() // share))
    return counted.where(F.col("callers") >= limit)


def witnesses(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """node, depth, parent: the smallest neighbour one level nearer to a seed."""
    near = reached.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"))
    step = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node")).distinct().join(near, "parent")
    return reached.join(step, ["node", "depth"], "left").groupBy("node", "depth").agg(F.min("parent").alias("parent"))


def frontier(edges: DataFrame, reached: DataFrame, max_depth: int) -> DataFrame:
    """node, reason, n_hidden: nodes at the depth limit that have neighbours which were not reached."""
    last = reached.where(F.col("depth") == max_depth).select("node")
    beyond = last.join(edges, last.node == edges.src).join(reached.select(F.col("node").alias("dst")), "dst", "left_anti")
    return beyond.groupBy("node").agg(F.countDistinct("dst").alias("n_hidden")).withColumn("reason", F.lit("depth_limit"))


def paths(edges: DataFrame, seeds: DataFrame, max_depth: int, limit: int = 100_000) -> DataFrame:
    """node, path, boundary: every way from the seeds, edge by edge, as an array of nodes.

    A way that comes back to a node on it ends there with boundary `cycle`; one at max_depth with further edges ends with
    `depth`. Ways can be many more than nodes: beyond `limit` of them in one level, that level is not expanded and its
    ways end with boundary `limit`, so what is missing is named.
    """
    edges = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "paths-edges")
    level = materialize(seeds.select("node").distinct().withColumn("path", F.array("node")), "paths")
    parts = [level.withColumn("boundary", F.lit(None).cast("string"))]
    for depth in range(1, max_depth + 1):
        step = level.join(edges, level.node == edges.src).select(F.col("dst").alias("node"), F.array_contains("path", F.col("dst")).alias("cycle"), F.concat("path", F.array("dst")).alias("path"))
        step = materialize(step, "paths")
        if step.isEmpty():
            break
        many = step.limit(limit + 1).count() > limit
        ends = F.when(F.col("cycle"), "cycle").when(F.lit(many), "limit").when(F.lit(depth == max_depth) & F.col("more").isNotNull(), "depth")
        further = edges.select(F.col("src").alias("node")).distinct().withColumn("more", F.lit(True))
        parts.append(step.join(further, "node", "left").select("node", "path", ends.alias("boundary")))
        if many:
            break
        level = step.where("not cycle").drop("cycle")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
