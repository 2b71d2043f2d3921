"""Salted aggregation, profiles, orphans, packed values: small cases and edges."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.operators import peg
from weftline.operators import profile as pf
from weftline.operators.enrichment import meeting
from weftline.operators.orphans import _numbers_by_partition, orphans
from weftline.operators.skew import count_rows, heavy_keys, max_of, min_of, salted_aggregate, sum_of, with_salt


def test_salted_equals_group_by_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None, i % 4, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string, kind int, v long").withColumn("salts", F.lit("a column of the caller"))
    heavy = heavy_keys(df, ["key"], F.col("id"), 0.05)
    assert "hot" in {r.key for r in heavy.collect()} and heavy.count() <= 20
    got = salted_aggregate(df, ["key"], F.col("id"), [count_rows("n"), sum_of("s", "v"), min_of("a", "v"), max_of("b", "v")], within=["kind"])
    want = df.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("a"), F.max("v").alias("b"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_hot_null_key_is_spread(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"k{i}", i) for i in range(4000)], "id long, key string, v long")
    heavy = heavy_keys(df, ["key"], F.col("id"))
    assert [r.key for r in heavy.collect()] == [None]
    assert with_salt(df, ["key"], F.col("id"), heavy).where("key is null").select("__salt").distinct().count() > 10
    assert salted_aggregate(df, ["key"], F.col("id"), [count_rows("n")]).where("key is null").first().n == 2000


def test_batches_have_a_partition_of_their_own(spark):
    no = _numbers_by_partition(spark, 7, 3)
    assert len(set(no)) == 21
    df = spark.createDataFrame([(x,) for x in no], "no long").repartition(7, "no").select(F.spark_partition_id().alias("p"))
    assert {r["count"] for r in df.groupBy("p").count().collect()} == {3}


def test_pairs_of_large_documents(spark):
    rng = random.Random(2)
    rows = sorted({(f"e{rng.randrange(60)}", rng.choice([1, 1, 1, 2, 3])) for _ in range(200)})
    s = spark.createDataFrame(rows, "source_id string, doc int")
    t = s.withColumnRenamed("source_id", "target_id")
    want = sorted((a, b, d) for a, d in rows for b, e in rows if d == e)
    for block in (1, 7, 1000):
        assert sorted(tuple(r) for r in meeting(s, t, block).collect()) == want


def test_salted_empty_and_tied_identity(spark):
    empty = spark.createDataFrame([], "id long, key string")
    assert salted_aggregate(empty, ["key"], F.col("id"), [count_rows("n")]).count() == 0
    same = spark.createDataFrame([(1, "x")] * 100, "id long, key string")
    assert [tuple(r) for r in salted_aggregate(same, ["key"], F.col("id"), [count_rows("n")]).collect()] == [("x", 100)]


def test_store_of_signed_deltas(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (" ", 1), ("bb", 2), ("z", None)], "c string, load_no int")
    store = pf.ValueCounts(spark, str(tmp_path / "store"))
    assert set(store.sync("t", df, ["c"])) == {1, 2, None} and store.sync("t", df, ["c"]) == []
    p = pf.column_profile(store.read(), {("t", "c"): "a+"}).first()
    assert (p.n_rows, p.n_null, p.n_distinct, p.min_value, p.max_value, p.max_length, p.n_format) == (6, 2, 3, "a", "z", 2, 2)
    assert p.entropy_bits == pytest.approx(1.5)
    before = sorted(map(str, store.read().collect()))
    more = df.union(spark.createDataFrame([("new", 8), ("a", 8)], df.schema))
    assert store.sync("t", more, ["c"]) == [8] and pf.column_profile(store.read()).first().n_rows == 8
    # Another process finds what is there; a load that came and went leaves nothing.
    again = pf.ValueCounts(spark, str(tmp_path / "store"))
    assert again.sync("t", df, ["c"]) == [8] and sorted(map(str, again.read().collect())) == before
    assert spark.read.parquet(again.path).where("sign = -1").count() == 2
    assert again.sync("t", more, ["c"]) == [8] and pf.column_profile(again.read()).first().n_rows == 8
    changed = more.where("not (load_no = 1 and c <=> 'a')").union(spark.createDataFrame([("q", 1)], df.schema))
    assert again.sync("t", changed, ["c"]) == [1] and {tuple(r) for r in again.read().where("load_no = 1").select("value", "n").collect()} == {(None, 1), (" ", 1), ("q", 1)}
    again.put(pf.value_counts(changed, "t", ["c"]), "t", [1, 2, 8, None])  # delivered twice
    assert pf.column_profile(again.read()).first().n_rows == 7
    assert sorted(map(str, again.compact().read().collect())) == sorted(map(str, again.read().collect()))
    nothing = pf.load_store({"t": (df.limit(0), ["c"])}).read()
    assert pf.column_profile(nothing).count() == 0 and pf.unusual_loads(nothing, {"nulls": [("t", "c")]}).count() == 0


def test_counts_of_billions(spark):
    rows = [("t", "c", load, v, n) for load in (1, 2, 3) for v, n in (("x" * 100, 3_000_000_000_000), (None, 1_000_000_000_000 * load))]
    counts = spark.createDataFrame(rows, "table_name string, column_name string, load_no int, value string, n long")
    assert {(r.kind, r.load_no) for r in pf.unusual_loads(counts, {"nulls": [("t", "c")], "length": [("t", "c")]}, null_gap=0.2).collect()} == {("nulls", 1)}
    r = {x.load_no: x for x in pf.load_distances(counts).collect()}
    assert r[1].value_distance == 0.0 and r[1].value_divergence == 0.0 and r[2].value_entropy == 0.0


def test_unusual_loads(spark):
    rows = [("x" * 30, 1)] * 30 + [("x" * 20, 2)] * 30 + [(None, 3)] * 10 + [("y" * 20, 3)] * 20 + [("z", 4)] * 5 + [("w", None)] * 40
    df = spark.createDataFrame([(v if v is None or len(v) > 1 else f"{v}{i:020d}"[:20], n) for i, (v, n) in enumerate(rows)], "c string, load_no int")
    counts = pf.load_store({"t": (df, ["c"])}).read()
    got = {(r.kind, r.load_no) for r in pf.unusual_loads(counts, {k: [("t", "c")] for k in ("nulls", "length", "repeats")}).collect()}
    assert got == {("nulls", 3), ("length", 1), ("repeats", 1), ("repeats", 2), ("repeats", 3)}


def test_orphans_over_time(spark):
    t = lambda n: datetime(2024, 1, n)
    parents = spark.createDataFrame([("a", t(2), t(5)), ("a", t(8), None), ("a", t(3), t(4)), ("b", t(9), None), (None, t(1), None), ("c", None, None)], "key string, born timestamp, died timestamp")
    refs = [(1, "a", t(1)), (2, "a", t(2)), (3, "a", t(4)), (4, "a", t(5)), (5, "a", t(9)), (6, "b", t(1)), (7, "zz", t(9)), (8, None, t(9)), (9, " ", t(9)), (10, "a ", t(3)), (11, "a", None), (12, "c", t(9))]
    df = spark.createDataFrame([(i, "s", k, at) for i, k, at in refs], "ref_id long, side string, key string, at timestamp")
    got = {(r.ref_id, r.kind) for r in orphans(df, parents).collect()}
    assert got == {(1, "later"), (4, "deleted"), (6, "later"), (7, "missing"), (10, "missing"), (11, "later"), (12, "missing")}
    assert orphans(df, parents.limit(0)).count() == 10
    assert orphans(df.limit(0), parents).count() == 0


def test_orphans_against_brute_force_with_a_hot_key_and_small_batches(spark):
    rng = random.Random(5)
    day = lambda: datetime(2024, 1, rng.randint(1, 28))
    ps = []
    for i in range(300):
        for _ in range(rng.choice([1, 1, 2, 4])):
            a, b = day(), day()
            ps.append((f"k{i}", a, rng.choice([None, max(a, b)])))
    refs = [(i, "s", "k7" if i % 3 == 0 else f"k{rng.randrange(400)}", day()) for i in range(3000)]
    by = {}
    for k, a, b in ps:
        by.setdefault(k, []).append((a, b))
    want = set()
    for i, _, k, at in refs:
        lives = by.get(k, [])
        if not any(a <= at and (b is None or b > at) for a, b in lives):
            want.add((i, "missing" if not lives else "deleted" if any(a <= at for a, _ in lives) else "later"))
    got = orphans(spark.createDataFrame(refs, "ref_id long, side string, key string, at timestamp"), spark.createDataFrame(ps, "key string, born timestamp, died timestamp"), per_range=50, per_batch=200)
    assert {(r.ref_id, r.kind) for r in got.collect()} == want


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a|b; c", ["a", "b", "c"]), ('"a|b"|c', ["a|b", "c"]), ('"so-called ""x"" disease"', ['so-called "x" disease']), ('"open|b', ["open", "b"]), ('a"b', ["a", "b"]), ("", []), (None, []), (" | ; ", []), ("x, acute (type 2)", ["x, acute (type 2)"]),
        ('""', []), ('  "q"  ', ["q"]), ("a¦b\nc\td", ["a", "b", "c", "d"]), ("é|ß", ["é", "ß"]), ('"a" "b"', ["a", "b"]), ("---|...", []), ("z" * 100_000, ["z" * 100_000]),
    ],
)
def test_synonym_grammar(spark, text, values):
    r = spark.createDataFrame([(text,)], "t string").select(F.transform(peg.split_values("t", peg.SYNONYMS), lambda v: v["value"]).alias("v")).first()
    assert list(r.v) == values


def test_flags_and_other_grammars(spark):
    df = spark.createDataFrame([('"open|b',), ("...",), ("a",), (None,), (" ",)], "t string")
    assert [r.f for r in df.select(peg.parse_flags("t", peg.SYNONYMS).alias("f")).collect()] == ["unclosed_quote", "no_value", None, None, None]
    df = spark.createDataFrame([('"MIM:1|HGNC:HGNC:2", x Ensembl:E.1', "PMID:12; 34,12", "[a; b]|c")], "x string, n string, l string")
    r = df.select(*[F.transform(peg.split_values(c, g), lambda v: v["value"]).alias(c) for c, g in (("x", peg.XREFS), ("n", peg.NUMBERS), ("l", peg.LISTS))]).first()
    assert (list(r.x), list(r.n), list(r.l)) == (["MIM:1", "HGNC:HGNC:2", "Ensembl:E.1"], ["12", "34", "12"], ["a; b", "c"])


def test_identifiers_by_their_form(spark):
    texts = ["mondo_0001234 ! x;MONDO:0005678", "MONDO:00012345 Mondo:7654321", "none", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string").withColumn("pos", F.lit("a clashing column"))
    got = [(r.row_id, r.pos, r.value, r.flag) for r in peg.value_rows(df, "t", peg.term_ids("MONDO")).collect()]
    assert got == [(0, 1, "MONDO:0001234", None), (0, 2, "MONDO:0005678", None), (1, 1, "MONDO:7654321", None), (2, None, None, "no_value")]


@pytest.mark.parametrize(("text", "values", "flag"), [
    ("[a; b]|c", ["a; b", "c"], None), ("[a; b|c", ["a", "b", "c"], "unclosed_bracket"), ('"x|y", [p]', ["x|y", "p"], None), ('"x|[p;q]', ["x", "p;q"], "unclosed_quote"), ('["a|b"]', ['"a|b"'], None), ("[]", [], "no_value"),
    ('a""b', ["a", "b"], None), ('"a""', ["a"], "unclosed_quote"), ("[a[b]", ["a", "b"], "unclosed_bracket"), ("a]b", ["a", "b"], None),
])
def test_malformed_quotes_and_brackets(spark, text, values, flag):
    r = spark.createDataFrame([(text,)], "t string").select(F.transform(peg.split_values("t", peg.LISTS), lambda v: v["value"]).alias("v"), peg.parse_flags("t", peg.LISTS).alias("f")).first()
    assert (list(r.v), r.f) == (values, flag)


def test_loads_with_other_values_of_like_number_and_length(spark):
    rng = random.Random(9)
    rows = [(load, rng.choice("ABCD") if load != 3 else rng.choice("WXYZ"), f"{rng.randrange(10**6):06d}" if load != 5 else "".join(rng.choice("abcdef") for _ in range(6)), rng.choice(["p", "q"])) for load in range(1, 9) for _ in range(60)]
    df = spark.createDataFrame(rows, "load_no int, kind string, id string, same string")
    store = pf.load_store({"t": (df, df.columns)})
    counts = store.read()
    assert spark.read.parquet(store.path).count() == counts.count()
    kinds = ["nulls", "length", "repeats"]
    assert pf.unusual_loads(counts.where("column_name <> 'same'"), {k: [("t", "kind"), ("t", "id")] for k in kinds[:2]}).count() == 0
    assert {(r.column_name, r.kind, r.load_no) for r in pf.different_loads(pf.load_distances(counts)).collect()} == {("kind", "values", 3), ("id", "shapes", 5)}
    d = {(r.column_name, r.load_no): r for r in pf.load_distances(counts).collect()}
    assert d["kind", 3].value_distance == 1.0 and d["kind", 3].value_divergence == 1.0 and 1.5 < d["kind", 3].value_entropy <= 2.0 and d["same", 1].value_distance < 0.2 and d["id", 1].shape_distance == pytest.approx(1 / 7, abs=1e-6)
    p = {r.column_name: r for r in pf.column_profile(counts, {("t", "kind"): "[A-D]"}, {("t", "load_no")}).collect()}
    assert p["kind"].n_format == 60 and p["id"].n_format is None and (p["load_no"].min_value, p["load_no"].max_value) == ("1", "8")
    only = pf.load_store({"t": (df.where("load_no = 1"), ["kind"]), "u": (df.select("kind"), ["kind"])}).read()
    assert [r.value_distance for r in pf.load_distances(only).collect()] == [None, None] and pf.different_loads(pf.load_distances(only)).count() == 0


def test_every_column_of_the_node_tables_is_profiled(spark):
    from weftline.plans.problems import QUERIES
    from weftline.plans.tables import table

    d = "/root/testdata/sf0.001"
    want = {(t, c) for t in ("disease_nodes", "phenotype_nodes", "genes", "chemical_nodes", "graph_nodes") for c in table(spark, d, t).columns}
    p = {(r.table_name, r.column_name): r for r in QUERIES["p5_profile"](spark, d).collect()}
    assert set(p) == want and p["genes", "Symbol"].n_format is None and p["chemical_nodes", "inchikey"].n_format is not None
    t = table(spark, d, "genes").agg(F.min("row_id"), F.max("row_id")).first()
    assert (p["genes", "row_id"].min_value, p["genes", "row_id"].max_value) == (str(t[0]), str(t[1]))
    assert {(r.table_name, r.column_name) for r in QUERIES["p5_distances"](spark, d).select("table_name", "column_name").distinct().collect()} == want
