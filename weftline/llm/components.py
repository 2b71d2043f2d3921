"""Pairwise matches to groups, by randomised graph contraction.

Each round draws a fresh hash order of the vertices. Every vertex hooks to the
vertex that comes first in its closed neighbourhood; links are relabelled to
the hooks, repeated links and loops fall away, and the round's hooks are kept.
The expected number of vertices that survive a round is at most a constant
fraction, whatever the graph looks like, so the rounds are logarithmic and
chains cost no more than stars. When no link is left, the kept hooks are
composed from the last round back to the first.

A neighbourhood is only ever reduced by a minimum, combined before the shuffle:
a vertex with a third of all links is one row per task. Joins bring a unique
row per vertex to the links, and adaptive execution splits a hot vertex's side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import Scratch, cut


def contract_groups(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``pairs(a, b)`` -> ``(node, root)``: one root per group of vertices linked
    directly or through others. Pairs with a null end are ignored, a vertex that
    only matches itself is a group of its own; an empty table gives none."""
    both = pairs.where("a is not null and b is not null").select("a", "b")
    vertices = cut(both.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "group-vertices")
    links = Scratch(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "group-links")
    hooks: list[Scratch] = []
    for r in range(max_rounds):
        if not links.df.take(1):
            break
        order = lambda c: F.xxhash64(F.lit(r), F.col(c))  # noqa: E731, B023
        near = links.df.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
        first = near.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("v"))).alias("m"))
        # Closed neighbourhood: the vertex itself may come first.
        hook = Scratch(first.select(F.col("a").alias("node"), F.when(F.struct(order("a").alias("o"), F.col("a").alias("v")) <= F.col("m"), F.col("a")).otherwise(F.col("m.v")).alias("root")), "hooks")
        hooks.append(hook)
        x = links.df.join(hook.df.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hook.df.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        new = Scratch(x.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "group-links")
        links.drop()
        links = new
    else:
        raise RuntimeError(f"links left after {max_rounds} rounds")
    root = None
    for hook in reversed(hooks):
        # A root of this round may have been hooked on in later ones.
        if root is None:
            root = hook.df
        else:
            later = root.select(F.col("node").alias("root"), F.col("root").alias("further"))
            root = cut(hook.df.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "groups")
    if root is None:
        return vertices.select("node", F.col("node").alias("root"))
    return vertices.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def group_matches(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` -> ``(node, group_id)``; group_id is the group's smallest vertex."""
    roots = cut(contract_groups(pairs), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("group_id"))
    return roots.join(least, "root").select("node", "group_id")


def star_pairs(memberships: DataFrame) -> DataFrame:
    """``memberships(node, key)`` -> ``(a, b)`` that link all nodes of a key: each to
    the smallest, never all pairs. Keys of one node give that node with itself,
    so that every node appears. Null keys and nodes are ignored."""
    m = memberships.where("node is not null and key is not null").select("node", "key").distinct()
    low = m.groupBy("key").agg(F.min("node").alias("a"))
    return m.join(low, "key").select("a", F.col("node").alias("b")).distinct()
