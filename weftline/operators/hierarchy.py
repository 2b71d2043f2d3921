"""Parent-child links to full hierarchies, by tree contraction.

A contraction step removes vertices whose place is determined by vertices that
stay, and records how:

* rake: a vertex without children is recorded with its parent links;
* compress: a vertex with one parent and one child is spliced out of its chain,
  chosen by a fresh hash order per round so that no two neighbours go at once
  (a third of every chain per round, so chains of length n take O(log n) rounds);
* a link that has closed on itself is a cycle exposed: it is recorded with the
  vertices spliced into it and taken out, so cycles never block the rest.

What neither step can touch is the non-terminating core: entangled cycles, and
what hangs between them. Where only cycles are asked for, vertices without
parents are raked in the same rounds. The core is contracted in turn: every
vertex follows one of its parent links, chosen by hash; the cycles of that map
(found by doubling the steps) and pairs of mutual parents shrink to one vertex
each, and rake and compress go on. A core that fits one task is finished there.

Cycles are then condensed to one vertex each, the acyclic remainder contracts
to nothing, and going through the records in reverse order recovers depth,
roots, ancestors and all paths of every vertex from vertices resolved before.
Every round of a contraction removes a vertex, so none is given up.

A vertex's children are only ever counted, so a parent that holds a third of
all rows is one counter; joins on it have the unique side hashed and leave the
large side to adaptive skew splitting. Ancestors and paths are rows, never lists.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.graph.components import connected_components
from weftline.storage import Scratch, cut

KEEP, RAKED, SPLICED, LOOP = 0, 1, 2, 3

#: Links of a core that one task takes: two ids and what was spliced between them.
PER_TASK = 1_000
#: A round that takes out less than this share of the links is worth a look for cycles to merge.
SLOW = 0.02


@dataclass
class Contraction:
    """``records``: (step, node, parent, seg) tables in the order of removal, steps
    without rows left out; ``loops``: (node, seg) closed links; ``core``: links
    (child, parent, seg) that were not contracted, or None, and their number."""

    records: list[tuple[int, DataFrame]] = field(default_factory=list)
    loops: list[DataFrame] = field(default_factory=list)
    core: DataFrame | None = None
    core_links: int = 0
    rounds: int = 0


def contract(links: DataFrame, patience: int = 8, both: bool = False, stop_at: int = 0, slow: float = 0.0) -> Contraction:
    """Contracts ``links(child, parent[, seg])``: distinct, without nulls. ``seg``
    holds the vertices spliced out between child and parent, nearest the child first.
    ``both`` also rakes vertices without parents in the same round, for finding
    cycles only: nothing is recorded then. With ``stop_at``, that many links or
    fewer are left as they are, as the core; so is what is left after a round that
    took out less than the share ``slow`` of the links."""
    out = Contraction()
    if "seg" not in links.columns:
        links = links.withColumn("seg", F.array().cast("array<string>"))
    now = Scratch(links.select("child", "parent", "seg", F.lit(KEEP).alias("act")), "contract")
    idle = 0
    left = now.df.count()
    for r in itertools.count():
        if not left:
            return out
        if left <= stop_at:
            out.core, out.core_links = now.df.where(f"act = {KEEP}").select("child", "parent", "seg"), left
            return out
        e = now.df.where(f"act = {KEEP}").select("child", "parent", "seg")
        # One pass counts links below and above every vertex; min() is the only link where there is one.
        ends = e.select(F.explode(F.array(
            F.struct(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"), F.col("parent").alias("above"), F.col("seg").alias("via"), F.lit(None).cast("string").alias("below")),
            F.struct(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"), F.lit(None).cast("string").alias("above"), F.lit(None).cast("array<string>").alias("via"), F.col("child").alias("below")),
        )).alias("x")).select("x.*")
        v = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.min("above").alias("above"), F.min("via").alias("via"), F.min("below").alias("below"))
        h = lambda c: F.xxhash64(F.col(c), F.lit(r))  # noqa: E731, B023
        spliced = (F.col("up") == 1) & (F.col("down") == 1) & (h("node") < h("above")) & (h("node") < h("below"))
        top = (F.col("up") == 0) & F.lit(both)
        gone = v.select("node", F.when(F.col("down") == 0, RAKED).when(spliced, SPLICED).when(top, -RAKED).alias("how"), "above", "via").where("how is not null")
        a = e.join(gone.where("how > 0").select(F.col("node").alias("child"), "how"), "child", "left")
        g = gone.where(f"how in ({SPLICED}, {-RAKED})").select(F.col("node").alias("parent"), F.when(F.col("how") == -RAKED, RAKED).alias("from_top"), "above", F.concat(F.array("node"), "via").alias("tail"))
        b = a.join(g, "parent", "left").withColumn("how", F.coalesce("how", "from_top"))
        hop = F.col("how").isNull() & F.col("above").isNotNull()
        parent = F.when(hop, F.col("above")).otherwise(F.col("parent"))
        nxt = b.select(
            "child", parent.alias("parent"), F.when(hop, F.concat("seg", "tail")).otherwise(F.col("seg")).alias("seg"),
            F.when(F.col("how").isNotNull(), F.col("how")).when(parent == F.col("child"), LOOP).otherwise(KEEP).alias("act"),
        )
        new = Scratch(nxt, "contract")
        n = {x.act: x["count"] for x in new.df.groupBy("act").count().collect()}
        if both and not (out.loops and out.loops[-1].path == now.path):
            now.drop()
        before, now, left = left, new, n.get(KEEP, 0)
        out.rounds = r + 1
        # Within a round a raked vertex may hang on a spliced one, so in reverse the splice comes first.
        for k, act in ((2 * r, RAKED), (2 * r + 1, SPLICED)):
            if n.get(act) and not both:
                out.records.append((k, new.df.where(f"act = {act}").select(F.col("child").alias("node"), "parent", "seg")))
        if n.get(LOOP):
            out.loops.append(new)
        # With nothing to rake, splicing may still pause by chance; only a lasting pause is the core.
        idle = 0 if n.get(RAKED) or n.get(SPLICED) or n.get(LOOP) else idle + 1
        if left and before - left < slow * before or idle and (idle >= patience or not _has_chain(new.df.where(f"act = {KEEP}"))):
            out.core, out.core_links = new.df.where(f"act = {KEEP}").select("child", "parent", "seg"), left
            return out
    raise AssertionError


def _has_chain(e: DataFrame) -> bool:
    up = e.groupBy(F.col("child").alias("node")).count().where("count = 1").select("node")
    down = e.groupBy(F.col("parent").alias("node")).count().where("count = 1").select("node")
    return bool(up.join(down, "node", "left_semi").take(1))


def _strong_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of the strongly connected sets among all links of a partition, of two or
    more vertices or one with a link to itself, in time linear in the links:
    depth-first, without recursion."""
    up: dict[str, list[str]] = {}
    own: set[str] = set()
    for b in batches:
        for child, parent in zip(b["child"], b["parent"], strict=True):
            up.setdefault(child, []).append(parent)
            up.setdefault(parent, [])
            if child == parent:
                own.add(child)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    done: set[str] = set()
    node, root = [], []
    for start in up:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        open_.append(start)
        walk = [(start, iter(up[start]))]
        while walk:
            at, todo = walk[-1]
            step = next(todo, None)
            if step is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
                if low[at] == number[at]:
                    members = [open_.pop()]
                    while members[-1] != at:
                        members.append(open_.pop())
                    done.update(members)
                    if len(members) > 1 or at in own:
                        node += members
                        root += [at] * len(members)
            elif step not in number:
                number[step] = low[step] = len(number)
                open_.append(step)
                walk.append((step, iter(up[step])))
            elif step not in done:
                low[at] = min(low[at], number[step])
    yield pd.DataFrame({"node": node, "root": root}, dtype=object)


def _followed_cycles(core: DataFrame, n: int, seed: int) -> DataFrame:
    """(node, root): the cycles of the map that sends every vertex along one parent link,
    chosen by hash. The steps are doubled until they are at least ``n``, the links,
    which every walk has then made its way into a cycle; root is a cycle's smallest vertex."""
    f = core.groupBy(F.col("child").alias("node")).agg(F.min_by("parent", F.xxhash64(F.lit(seed), "child", "parent")).alias("to"))
    t = Scratch(f.select("node", "to", F.least("node", "to").alias("low")), "follow")
    for _ in range(max(1, n - 1).bit_length()):
        further = t.df.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        new = Scratch(t.df.join(further, "to").select("node", F.col("to2").alias("to"), F.least("low", "low2").alias("low")), "follow")
        t.drop()
        t = new
    return t.df.join(t.df.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("root"))


def _coloured_sets(core: DataFrame) -> DataFrame:
    """(node, root): the smallest vertex flows down to everything below it; what also leads
    back up to its colour's owner within the colour is strongly connected to it.
    As many rounds as the core is deep."""
    e = cut(core.select("child", "parent").distinct(), "core")
    colour = Scratch(e.select(F.explode(F.array("child", "parent")).alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(True).alias("moved")), "colour")
    while colour.df.where("moved").take(1):
        below = e.join(colour.df.select(F.col("node").alias("parent"), "root"), "parent").groupBy(F.col("child").alias("node")).agg(F.min("root").alias("r"))
        new = Scratch(colour.df.join(below, "node", "left").select("node", F.least("root", "r").alias("root"), F.coalesce(F.col("r") < F.col("root"), F.lit(False)).alias("moved")), "colour")
        colour.drop()
        colour = new
    c = colour.df.select("node", "root")
    inner = cut(e.join(c.select(F.col("node").alias("child"), "root"), "child").join(c.select(F.col("node").alias("parent"), F.col("root").alias("root2")), "parent").where("root = root2").select("child", "parent", "root"), "inner")
    reached = Scratch(c.where("node = root").select("node", "root", F.lit(True).alias("fresh")), "reached")
    while reached.df.where("fresh").take(1):
        # Upwards from the owner: its colour's vertices that have it as a descendant.
        up = inner.join(reached.df.where("fresh").select(F.col("node").alias("child")), "child", "left_semi").select(F.col("parent").alias("node"), "root").distinct()
        fresh = up.join(reached.df.select("node"), "node", "left_anti").withColumn("fresh", F.lit(True))
        new = Scratch(reached.df.withColumn("fresh", F.lit(False)).unionByName(fresh), "reached")
        reached.drop()
        reached = new
    return reached.df.where("node <> root").select("node", "root")


def _within(e: DataFrame, group: DataFrame) -> DataFrame:
    """(node, root) of the vertices spliced into links both of whose ends are in one group."""
    a = group.select(F.col("node").alias("child"), "root")
    b = group.select(F.col("node").alias("parent"), F.col("root").alias("root2"))
    return e.join(a, "child").join(b, "parent").where("root = root2").select(F.explode("seg").alias("node"), "root")


def cycles(links: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, cycle_id): every vertex that is its own ancestor; cycle_id is the
    smallest vertex that is both above and below it. ``links(child, parent)``;
    nulls are ignored, an empty table gives an empty result."""
    sets: list[DataFrame] = []
    e, slow = clean_links(links), SLOW
    for r in itertools.count():
        c = contract(e, both=True, stop_at=per_task, slow=slow)
        sets += [x.df.where(f"act = {LOOP}").select(F.explode(F.concat(F.array("child"), "seg")).alias("node"), F.col("child").alias("root")) for x in c.loops]
        if c.core is None:
            break
        if c.core_links <= per_task:
            group = cut(c.core.select("child", "parent").coalesce(1).mapInPandas(_strong_sets, "node string, root string"), "strong")
            sets += [group, _within(c.core, group)]
            break
        mutual = c.core.select(F.col("child").alias("a"), F.col("parent").alias("b")).intersect(c.core.select(F.col("parent").alias("a"), F.col("child").alias("b")))
        followed = _followed_cycles(c.core, c.core_links, r)
        group = Scratch(connected_components(mutual.unionByName(followed.select(F.col("node").alias("a"), F.col("root").alias("b")))).select("node", F.col("component").alias("root")), "merged")
        merged = group.df.where("node <> root").count()
        # If rounds are slow for want of cycles, they go on until nothing more can be taken out.
        stuck, slow = slow == 0.0, SLOW if merged >= SLOW * c.core_links else 0.0
        # Following links merges long cycles at once; where it merges little, the core is tangled but not deep.
        if stuck and merged * 8 < c.core_links:
            coloured = _coloured_sets(c.core).select(F.col("node").alias("a"), F.col("root").alias("b"))
            group = Scratch(connected_components(coloured.unionByName(group.df.select(F.col("node").alias("a"), F.col("root").alias("b")))).select("node", F.col("component").alias("root")), "merged")
        sets += [group.df, cut(_within(c.core, group.df), "within")]
        a = group.df.select(F.col("node").alias("child"), F.col("root").alias("c"))
        b = group.df.select(F.col("node").alias("parent"), F.col("root").alias("p"))
        x = c.core.join(a, "child", "left").join(b, "parent", "left").select(F.coalesce("c", "child").alias("child"), F.coalesce("p", "parent").alias("parent"), "seg").where("child <> parent")
        # Links that have become one keep what was spliced into any of them: it only says who belongs to a cycle.
        e = x.groupBy("child", "parent").agg(F.flatten(F.collect_list("seg")).alias("seg"))
    member = None
    for x in sets:
        member = x if member is None else member.unionByName(x)
    if member is None:
        return links.select(F.col("child").alias("node"), F.col("parent").alias("cycle_id")).limit(0)
    # Strongly connected sets that share a vertex are one.
    return connected_components(member.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "cycle_id")


def clean_links(links: DataFrame) -> DataFrame:
    return links.where("child is not null and parent is not null").select("child", "parent").distinct()


@dataclass
class Condensed:
    """Links without cycles (each cycle stands as its smallest member), the vertices that
    are no other member of a cycle, (node, cycle_id) of the cycles or None, and the
    contraction of the links."""

    links: DataFrame
    tops: DataFrame
    place: DataFrame | None
    contraction: Contraction


def condense(links: DataFrame, nodes: DataFrame, per_task: int = PER_TASK) -> Condensed:
    nodes = cut(nodes.where("node is not null").select("node").distinct(), "nodes")
    links = cut(clean_links(links).join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").join(nodes.select(F.col("node").alias("child")), "child", "left_semi").select("child", "parent"), "links")
    place = cut(cycles(links, per_task), "cycles")
    tops = nodes
    if not place.take(1):
        return Condensed(links, tops, None, contract(links))
    m = place.select(F.col("node").alias("child"), F.col("cycle_id").alias("c"))
    links = links.join(m, "child", "left").withColumn("child", F.coalesce("c", "child")).drop("c")
    links = links.join(m.withColumnRenamed("child", "parent"), "parent", "left").withColumn("parent", F.coalesce("c", "parent")).drop("c")
    links = cut(links.where("child <> parent").distinct(), "links")
    tops = nodes.join(place.where("node <> cycle_id").select("node"), "node", "left_anti")
    return Condensed(links, tops, place, contract(links))


def _expand(c: Condensed, first: dict, step: dict, merged: dict | None) -> DataFrame:
    """Goes through the records of a complete contraction in reverse. Columns begin as
    ``first`` at the roots and follow a record's link by ``step``; ``merged``
    puts the rows of a vertex together, None leaves them as distinct rows."""
    roots = c.tops.join(c.links.select(F.col("child").alias("node")), "node", "left_anti").select("node", *[x.alias(k) for k, x in first.items()])
    parts = [Scratch(roots, "place")]

    def known() -> DataFrame:
        x = parts[0].df
        for y in parts[1:]:
            x = x.unionByName(y.df)
        return x

    for _, rec in sorted(c.contraction.records, key=lambda x: -x[0]):
        j = rec.join(known().withColumnRenamed("node", "parent"), "parent").select("node", *[x.alias(k) for k, x in step.items()])
        new = j.groupBy("node").agg(*[x.alias(k) for k, x in merged.items()]) if merged else j.distinct()
        parts.append(Scratch(new, "place"))
        if len(parts) > 8:  # few files to read again in each step
            whole = Scratch(known(), "place")
            for x in parts:
                x.drop()
            parts = [whole]
    return known()


#: Vertices between a record's ends; seg runs from the child upwards, paths from the root downwards.
_HOP = "size(seg) + 1"
_TAIL = "concat(' > ', array_join(concat(reverse(seg), array(node)), ' > '))"


def _with_members(out: DataFrame, place: DataFrame | None) -> DataFrame:
    """Rows of a cycle for each of its members, with the cycle's id."""
    if place is None:
        return out.withColumn("cycle_id", F.lit(None).cast("string"))
    p = place.select(F.col("node").alias("own"), F.col("cycle_id").alias("node"))
    x = out.join(p, "node", "left")
    return x.withColumn("cycle_id", F.when(F.col("own").isNotNull(), F.col("node"))).withColumn("node", F.coalesce("own", "node")).drop("own")


def hierarchy(links: DataFrame, nodes: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """One row per vertex: (node, cycle_id, depth_min, depth_max, n_paths, roots).

    ``links(child, parent)`` and ``nodes(node)``; links to vertices that are not
    in ``nodes`` are left out, a vertex without parents is a root of depth 0.
    Vertices of one cycle share a place: ``cycle_id`` is set, and the cycle
    counts as one vertex, its smallest member. ``roots`` is sorted and distinct.
    Nulls in either input and repeated rows have no effect; empty tables give
    an empty result.
    """
    c = condense(links, nodes, per_task)
    one = F.lit(1).cast("decimal(38,0)")
    first = {"depth_min": F.lit(0), "depth_max": F.lit(0), "n_paths": one, "roots": F.array("node")}
    step = {"depth_min": F.expr(f"depth_min + {_HOP}"), "depth_max": F.expr(f"depth_max + {_HOP}"), "n_paths": F.col("n_paths"), "roots": F.col("roots")}
    merged = {"depth_min": F.min("depth_min"), "depth_max": F.max("depth_max"), "n_paths": F.sum("n_paths").cast("decimal(38,0)"), "roots": F.array_distinct(F.flatten(F.collect_list("roots")))}
    out = _expand(c, first, step, merged).withColumn("roots", F.array_sort("roots"))
    return _with_members(out, c.place).select("node", "cycle_id", "depth_min", "depth_max", "n_paths", "roots")


def paths(links: DataFrame, nodes: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, path): every path from a root down to every vertex, joined by " > ", as rows.
    Inputs as in ``hierarchy``; on paths a cycle stands as its smallest member, and
    each of its members has the cycle's paths."""
    c = condense(links, nodes, per_task)
    # Different links and different segments never make the same path twice.
    out = _expand(c, {"path": F.col("node")}, {"path": F.expr(f"concat(path, {_TAIL})")}, None)
    return _with_members(out, c.place).select("node", "path")


def ancestors(links: DataFrame, nodes: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, ancestor): distinct pairs of a vertex and a vertex above it, as rows. Inputs
    as in ``hierarchy``; all members of a cycle are above what is below it, and
    above each other and themselves."""
    c = condense(links, nodes, per_task)
    # The vertex itself is carried along, so that one step gives all that is above.
    out = _expand(c, {"ancestor": F.col("node")}, {"ancestor": F.explode(F.concat(F.array("ancestor", "node"), "seg"))}, None)
    if c.place is None:
        return out.where("node <> ancestor")
    p = c.place.select(F.col("node").alias("own"), F.col("cycle_id").alias("ancestor"))
    x = _with_members(out, c.place).join(p, "ancestor", "left")
    above = F.coalesce("own", "ancestor")
    return x.where(F.col("cycle_id").isNotNull() | (F.col("node") != F.col("ancestor"))).select("node", above.alias("ancestor"))
