import random

import pytest
from pyspark.sql import functions as F

from weftline.graph.components import connected_components
from weftline.operators import hierarchy as hi
from weftline.operators.hierarchy import ancestors, cycles, hierarchy, paths


def brute(links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    reach = {}
    for v in up:
        seen, todo = set(), list(up[v])
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += up.get(w, ())
        reach[v] = seen
    cyc = {v: min(w for w in reach[v] if v in reach.get(w, ())) for v in reach if v in reach[v]}
    return reach, cyc


def frame(spark, links):
    return spark.createDataFrame(links, "child string, parent string")


def tangled(rng):
    links = []
    for k in range(12):  # separate small graphs, many of them entangled
        n = rng.randint(3, 9)
        links += [(f"g{k}v{rng.randrange(n)}", f"g{k}v{rng.randrange(n)}") for _ in range(rng.randint(3, 14))]
    links += [(f"c{i}", f"c{i + 1}") for i in range(40)]  # a chain
    return links + [(f"r{i}", f"r{(i + 1) % 25}") for i in range(25)] + [("r3", "c0"), ("x", "r9")]  # a ring with a tail either side


@pytest.mark.parametrize("per_task", [0, 1000])
def test_cycles_against_brute_force(spark, per_task):
    links = tangled(random.Random(3))
    got = {(r.node, r.cycle_id) for r in cycles(frame(spark, links), per_task).collect()}
    assert got == set(brute(links)[1].items())


def test_long_mutual_chains_take_few_rounds(spark, monkeypatch):
    n, rounds = 1000, []
    links = [(f"m{i:04d}", f"m{i + 1:04d}") for i in range(n - 1)]
    links += [(p, c) for c, p in links] + [("below", "m0500"), ("m0500", "above")]
    inner = hi.contract
    monkeypatch.setattr(hi, "contract", lambda *a, **k: rounds.append(c := inner(*a, **k)) or c)
    got = {(r.node, r.cycle_id) for r in cycles(frame(spark, links), per_task=0).collect()}
    assert got == {(f"m{i:04d}", "m0000") for i in range(n)} and sum(c.rounds for c in rounds) < 40


def test_cores_without_mutual_links(spark):
    n = 120
    links = [(f"v{i:03d}", f"v{(i + k) % n:03d}") for i in range(n) for k in (1, 2)]  # deep
    links += [("w0", "w1"), ("w0", "w2"), ("w1", "w3"), ("w2", "w3"), ("w3", "w4"), ("w3", "w5"), ("w4", "w0"), ("w5", "w0"), ("v000", "w0")]
    got = {(r.node, r.cycle_id) for r in cycles(frame(spark, links), per_task=0).collect()}
    assert got == {(f"v{i:03d}", "v000") for i in range(n)} | {(f"w{i}", "w0") for i in range(6)}
    core = frame(spark, links)
    assert {(r.node, r.root) for r in hi._coloured_sets(core).collect()} >= {(f"v{i:03d}", "v000") for i in range(1, n)}


@pytest.mark.parametrize("per_task", [0, 1000])
def test_components(spark, per_task):
    rng = random.Random(5)
    e = [(f"{k}-{rng.randrange(12)}", f"{k}-{rng.randrange(12)}") for k in range(8) for _ in range(9)] + [("solo", "solo"), (None, "q"), ("q", None)] + [(f"z{i}", f"z{i + 1}") for i in range(50)]
    low = {x: x for p in e if None not in p for x in p}
    while True:
        new = dict(low)
        for a, b in (p for p in e if None not in p):
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    assert {(r.node, r.component) for r in connected_components(spark.createDataFrame(e, "a string, b string"), per_task).collect()} == set(low.items())


def test_nulls_repeats_self_links_and_empty(spark):
    links = [("a", "a"), ("b", None), (None, "c"), ("d", "e"), ("d", "e")]
    assert [tuple(r) for r in cycles(frame(spark, links)).select("node", "cycle_id").collect()] == [("a", "a")]
    assert cycles(frame(spark, [])).count() == 0
    assert hierarchy(frame(spark, []), spark.createDataFrame([], "node string")).count() == 0


def test_places_paths_and_ancestors(spark):
    #     r        q
    #   a   b   (missing parent of q is left out)
    #    \\ / \\
    #     c   s <-> t, u below t
    links = [("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("s", "b"), ("s", "t"), ("t", "s"), ("u", "t"), ("q", "nowhere"), ("c", "b"), ("v", "c")]
    nodes = spark.createDataFrame([(x,) for x in "rabcstuqv"] + [(None,)], "node string").withColumn("child", F.lit("a clashing column"))
    h = {r.node: r for r in hierarchy(frame(spark, links), nodes).collect()}
    assert set(h) == set("rabcstuqv")
    assert (h["c"].depth_min, h["c"].depth_max, int(h["c"].n_paths)) == (2, 2, 2) and h["v"].roots == ["r"] and h["v"].depth_max == 3
    assert h["q"].roots == ["q"] and h["q"].depth_min == 0 and h["t"].cycle_id == "s" and h["u"].cycle_id is None
    p = sorted(tuple(r) for r in paths(frame(spark, links), nodes).collect())
    assert p == sorted([("r", "r"), ("q", "q"), ("a", "r > a"), ("b", "r > b"), ("c", "r > a > c"), ("c", "r > b > c"), ("v", "r > a > c > v"), ("v", "r > b > c > v"), ("s", "r > b > s"), ("t", "r > b > s"), ("u", "r > b > s > u")])
    pairs = [(r.ancestor, r.node) for r in ancestors(frame(spark, links), nodes).collect()]
    reach, _ = brute([x for x in links if x[1] != "nowhere"])
    assert sorted(pairs) == sorted((a, v) for v, s in reach.items() for a in s)


def test_a_chain_of_150_levels(spark):
    links = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    nodes = spark.createDataFrame([(f"c{i:03d}",) for i in range(151)], "node string")
    h = {r.node: r.depth_max for r in hierarchy(frame(spark, links), nodes).collect()}
    assert h == {f"c{i:03d}": 150 - i for i in range(151)}
    assert ancestors(frame(spark, links), nodes).count() == 150 * 151 // 2
    assert max(len(r.path.split(" > ")) for r in paths(frame(spark, links), nodes).collect()) == 151
