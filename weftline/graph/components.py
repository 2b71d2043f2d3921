"""Connected components by randomised contraction (core use: graph metrics and
overlapping cycles). In every round each vertex hooks to the first of its closed
neighbourhood in a fresh hash order, links are relabelled and made distinct, so
the rounds are logarithmic whatever the graph looks like. Once the links left
are few enough for one task (``per_task``), that task finishes them. No
component is ever gathered before that: neighbours are only reduced by ``min``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import Scratch, cut

#: Links that one task takes: two ids each, some 50 MB with Python's overhead.
PER_TASK = 200_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all links of a partition, by union-find with halving."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b["a"], b["b"], strict=True):
            p, q = top(x), top(y)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "root": [top(x) for x in nodes]}, dtype=object)


def connected_components(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """``edges(a, b)`` of text ids -> ``(node, component)``; component is the smallest node id.

    Rows with a null end are ignored; self loops and repeated edges are allowed
    (a node with only a self loop is its own component). An empty input gives
    an empty result.
    """
    both = cut(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    links = Scratch(both.where("a <> b"), "cc-links")
    hooks: list[DataFrame] = []
    for r in itertools.count():
        n = links.df.count()
        if not n:
            break
        if n <= per_task:
            hooks.append(cut(links.df.coalesce(1).mapInPandas(_joined, "node string, root string"), "cc-hooks"))
            break
        order = lambda c: F.xxhash64(F.lit(r), F.col(c))  # noqa: E731, B023
        near = links.df.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
        first = near.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(order("a").alias("o"), F.col("a").alias("v"))
        hook = cut(first.select(F.col("a").alias("node"), F.least(own, "m")["v"].alias("root")), "cc-hooks")
        hooks.append(hook)
        ends = lambda c: hook.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        x = links.df.join(ends("a"), "a").join(ends("b"), "b").where("ra <> rb")
        new = Scratch(x.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-links")
        links.drop()
        links = new
    if not hooks:
        return both.select(F.col("a").alias("node"), F.col("a").alias("component"))
    root = hooks[-1]
    for hook in reversed(hooks[:-1]):
        # A root of this round may have been hooked on in later ones.
        later = root.select(F.col("node").alias("root"), F.col("root").alias("further"))
        root = hook.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    root = cut(root, "cc-roots")
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    joined = root.join(least, "root").select("node", "component")
    alone = both.where("a = b").select(F.col("a").alias("node")).join(joined.select("node"), "node", "left_anti")
    return joined.unionByName(alone.select("node", F.col("node").alias("component")))
