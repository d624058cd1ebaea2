"""Bounded walks over edge tables. Each level is one equi-join; depth is a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_scores(seeds: DataFrame, edges: DataFrame, depth: int = 2, base: int = 30, decay: int = 8, least: int = 8) -> DataFrame:
    """Scores that spread from seeds (entity) along edges (src, dst), both ways: entity, score, distance.

    Entities are visited once, at their distance; each edge that leaves a visited entity adds max(least, base - decay * d)
    to its other end, d being the distance of that end if entered by this edge.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    frontier = seeds.select("entity").distinct().withColumn("distance", F.lit(0).cast("long"))
    seen, scores = frontier, []
    for d in range(1, depth + 1):
        step = frontier.join(both, frontier["entity"] == both["src"]).groupBy("dst").agg((F.count("*") * max(least, base - decay * d)).alias("score"))
        scores.append(step.select(F.col("dst").alias("entity"), "score"))
        frontier = step.select(F.col("dst").alias("entity")).join(seen.select("entity"), "entity", "left_anti").withColumn("distance", F.lit(d).cast("long"))
        seen = seen.unionByName(frontier)
    total = reduce(DataFrame.unionByName, scores).groupBy("entity").agg(F.sum("score").cast("long").alias("score"))
    return total.join(seen, "entity")


def paths(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """All simple paths of 1 to depth edges from starts (entity): start, entity, path (array), hops. Cycles end a path."""
    now = starts.select(F.col("entity").alias("start"), "entity", F.array("entity").alias("path"))
    out = []
    for d in range(1, depth + 1):
        now = now.join(edges, now["entity"] == edges["src"]).filter(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("entity"), F.concat("path", F.array("dst")).alias("path"))
        out.append(now.withColumn("hops", F.lit(d).cast("long")))
    return reduce(DataFrame.unionByName, out)


def shortest(all_paths: DataFrame) -> DataFrame:
    """The shortest path of each start and entity; the smallest of equal lengths."""
    return all_paths.groupBy("start", "entity").agg(F.min(F.struct("hops", "path")).alias("b")).select("start", "entity", F.col("b.hops").alias("hops"), F.col("b.path").alias("path"))


def levels(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Topological level of each node (node): 0 without dependencies, else one more than its deepest one. Edges are (src, dst): src needs dst.

    Raises if a cycle keeps levels growing: for most rounds, or as many as there are nodes, which no chain outlasts.
    """
    from lodeworks.sources.snapshots import cut

    level = nodes.select("node").withColumn("level", F.lit(0).cast("long"))
    for _ in range(nodes.select("node").distinct().count() if most is None else most):
        deeper = edges.join(level, edges["dst"] == level["node"]).groupBy("src").agg((F.max("level") + 1).alias("want"))
        after = cut(level.join(deeper, level["node"] == deeper["src"], "left").select("node", F.greatest("level", F.coalesce("want", F.lit(0))).alias("level")))
        if after.join(level.withColumnRenamed("level", "was"), "node").filter("level <> was").isEmpty():
            return after
        level = after
    raise ValueError("the dependencies have a cycle")


def skipped_dependents(nodes: DataFrame, edges: DataFrame, failed: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that need a failed one, directly or not; at most depth steps away if given. A failed node on a cycle needs itself."""
    from lodeworks.sources.snapshots import cut

    first = failed.select("node").distinct()
    now, found, d = first, first.limit(0), 0
    while depth is None or d < depth:
        step = edges.join(now, edges["dst"] == now["node"], "left_semi").select(F.col("src").alias("node")).distinct()
        now = cut(step.join(found, "node", "left_anti"))
        if now.isEmpty():
            break
        found, d = cut(found.unionByName(now)), d + 1
    return found
