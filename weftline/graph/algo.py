"""Graph measures over edge tables: depth, closure, components, degrees."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.graph.components import connected_components
from weftline.storage import Scratch, cut


def bfs_depth(edges: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, depth)`` of all nodes reachable from the root, by
    levels: each level joins only its own frontier, and known nodes are dropped. With
    ``max_depth``, nodes deeper than that are an error."""
    spark = edges.sparkSession
    e = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "bfs-edges")
    frontier = Scratch(spark.createDataFrame([(root, 0)], "node string, depth int"), "bfs")
    seen = frontier.df
    for level in itertools.count(1):
        nxt = e.join(frontier.df.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = Scratch(nxt.withColumn("depth", F.lit(level)), "bfs")
        if not frontier.df.take(1):
            break
        if max_depth is not None and level > max_depth:
            raise RuntimeError(f"nodes deeper than {max_depth} levels")
        seen = seen.unionByName(frontier.df)
        if level % 10 == 0:
            seen = cut(seen, "bfs-seen")
    return seen


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``edges(child, parent)`` -> all distinct (child, ancestor), cycle-safe: paths are
    doubled per round, so a hierarchy of depth n takes log n rounds. Its size is
    that of the result; for large hierarchies see operators.hierarchy."""
    reach = cut(edges.where("child is not null and parent is not null").select("child", F.col("parent").alias("ancestor")).distinct(), "closure")
    n = reach.count()
    for _ in range(max_rounds):
        two = reach.join(reach.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("further")), "ancestor").select("child", F.col("further").alias("ancestor"))
        reach = cut(reach.unionByName(two).distinct(), "closure")
        m = reach.count()
        if m == n:
            return reach
        n = m
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")


def degrees(edges: DataFrame, start: str = "start_id", end: str = "end_id", by: Sequence[str] = ()) -> DataFrame:
    """(node, degree), or per values of ``by``: ends counted on both sides, a self loop counts
    twice, a null end not at all."""
    return edges.select(*by, F.explode(F.array(start, end)).alias("node")).where("node is not null").groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame, node_id: str = "id") -> DataFrame:
    """Nodes that are on no edge."""
    return nodes.join(degrees(edges).select(F.col("node").alias(node_id)), node_id, "left_anti")


def mean_degree(nodes: DataFrame, edges: DataFrame, group: str = "node_type") -> DataFrame:
    """Mean degree per node type, nodes without edges counting 0, nodes without an id not."""
    d = degrees(edges).withColumnRenamed("node", "id")
    return nodes.where("id is not null").join(d, "id", "left").groupBy(group).agg(F.avg(F.coalesce("degree", F.lit(0))).alias("mean_degree"))


def component_summary(nodes: DataFrame, edges: DataFrame, start: str = "start_id", end: str = "end_id", node_id: str = "id") -> DataFrame:
    """One row: nodes (those listed and those on edges), components, size and share of
    the largest. A node without edges is a component of its own; edges with a null
    end are left out; without any node the share is null."""
    listed = nodes.select(F.col(node_id).alias("a"), F.col(node_id).alias("b"))
    c = connected_components(edges.select(F.col(start).alias("a"), F.col(end).alias("b")).unionByName(listed))
    s = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), (F.max("n") / F.sum("n")).alias("largest_fraction"))
