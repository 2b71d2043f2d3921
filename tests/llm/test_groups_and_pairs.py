import random
from math import log2

import pytest

from weftline.llm import queries
from weftline.llm.components import group_matches, star_pairs
from weftline.llm.cooccurrence import associations, pair_counts


def union_find(pairs):
    up = {}

    def find(v):
        up.setdefault(v, v)
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(up)}


def test_groups_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(f"v{rng.randrange(400):03d}", f"v{rng.randrange(400):03d}") for _ in range(260)]
    pairs += [(f"chain{i:03d}", f"chain{i + 1:03d}") for i in range(120)] + [("hub", f"leaf{i:03d}") for i in range(200)] + [("alone", "alone")]
    df = spark.createDataFrame([*pairs, *pairs[:20], (None, "n"), ("n", None), (None, None)], "a string, b string")
    assert {r.node: r.group_id for r in group_matches(df).collect()} == union_find(pairs)


def test_groups_of_nothing_and_of_numbers(spark):
    assert group_matches(spark.createDataFrame([], "a string, b string")).count() == 0
    got = group_matches(spark.createDataFrame([(3, 2), (2, 1), (9, 9)], "a long, b long")).collect()
    assert {(r.node, r.group_id) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_star_pairs(spark):
    m = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "k"), ("c", "k"), ("d", "j"), (None, "k"), ("e", None)], "node string, key string")
    assert {tuple(r) for r in star_pairs(m).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d")}


def brute_pairs(baskets):
    out = {}
    for items in baskets.values():
        s = sorted(items)
        for i, a in enumerate(s):
            for b in s[i + 1 :]:
                out[a, b] = out.get((a, b), 0) + 1
    return out


def test_pair_counts_with_a_basket_of_many_blocks(spark):
    rng = random.Random(2)
    baskets = {b: {f"i{rng.randrange(60):02d}" for _ in range(rng.choice([1, 2, 5, 9]))} for b in range(80)} | {1000: {f"i{k:02d}" for k in range(60)}, 1001: {f"i{k:02d}" for k in range(30)}}
    df = spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s], "basket long, item string")
    assert {(r.item0, r.item1): r.n01 for r in pair_counts(df, block=8).collect()} == brute_pairs(baskets)


def test_associations(spark):
    rng = random.Random(4)
    rows = [(b, f"i{min(rng.randrange(1, 40), rng.randrange(1, 40)):02d}") for b in range(150) for _ in range(6)]
    baskets = {}
    for b, i in rows:
        baskets.setdefault(b, set()).add(i)
    n, marg = 200, {}
    for s in baskets.values():
        for i in s:
            marg[i] = marg.get(i, 0) + 1
    want = {k: (marg[k[0]], marg[k[1]], v) for k, v in brute_pairs(baskets).items() if v >= 2 and v * n >= 1.5 * marg[k[0]] * marg[k[1]]}
    df = spark.createDataFrame([*rows, *rows[:50], (None, "i01"), (3, None)], "basket long, item string")
    got = associations(df, n, 2, 1.5).collect()
    assert {(r.item0, r.item1): (r.n0, r.n1, r.n01) for r in got} == want and want
    for r in got:
        assert r.pmi == pytest.approx(log2(r.n01 * n / (r.n0 * r.n1)))
    assert associations(df.limit(0), 0).count() == 0


def test_every_pair_of_items_is_reported(spark, tmp_path):
    mesh = [(1, "MESH:d1"), (1, "D2"), (2, " D1 "), (2, "D2"), (2, "D3"), (3, "D3"), (4, None)]
    spark.createDataFrame(mesh, "pmid long, mesh_id string").write.parquet(f"{tmp_path}/pmid_mesh.parquet")
    spark.createDataFrame([("C9", "3|5"), ("D1", None)], "ChemicalID string, PubMedIDs string").write.parquet(f"{tmp_path}/ctd_interactions.parquet")
    got = {(r.mesh_id_0, r.mesh_id_1): (r.n0, r.n1, r.n01, r.lift) for r in queries.QUERIES["p3_all"](spark, str(tmp_path)).collect()}
    # Five articles, among them one without an item.
    assert got == {("D1", "D2"): (2, 2, 2, 2.5), ("D1", "D3"): (2, 2, 1, 1.25), ("D2", "D3"): (2, 2, 1, 1.25), ("C9", "D3"): (2, 2, 1, 1.25)}
    assert queries.QUERIES["p3_pairs"](spark, str(tmp_path)).count() == 0


def test_counts_of_billions_do_not_overflow(spark):
    items = spark.createDataFrame([(b, i) for b in range(4) for i in "xy"], "basket long, item string")
    r = associations(items, 5_000_000_000_000_000_000, 1, 5.0).first()
    assert (r.n0, r.n1, r.n01) == (4, 4, 4) and abs(r.lift / 1.25e18 - 1) < 1e-12
