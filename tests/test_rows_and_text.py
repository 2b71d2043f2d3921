from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from weftline.functions import nested as n
from weftline.functions import text as x
from weftline.operators import rows
from weftline.operators.enrichment import pair_statistics, with_fisher


def one(spark, value, f, t="string"):
    return spark.createDataFrame([(value,)], f"v {t}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (x.strip, "  a \t", "a"), (x.strip, None, None), (x.slug, " A b/c.1 ", "a_b_c.1"), (lambda c: x.lstrip_chars(c, "CID:"), "CID:C1", "1"), (lambda c: x.ensure_prefix(c, "MESH:"), " D1 ", "MESH:D1"), (lambda c: x.ensure_prefix(c, "MESH:"), "MESH:D1", "MESH:D1"),
        (lambda c: x.ensure_prefix(c, "MESH:", True), None, ""), (x.local_name, "http://a/b#c", "c"), (x.local_name, "http://a/b", "b"), (x.stitch_to_compound, "CID100002441", "2441"), (x.stitch_to_compound, "CID0x", ""), (x.stitch_to_compound, None, ""),
        (x.definition_before_last_bracket, '"one "two" [a] three" [x, y]', 'one "two" [a] three'), (x.definition_before_first_bracket, '"text" [GO:1] more', "text"), (x.first_quoted, '"a b" EXACT []', "a b"), (x.first_token, " HP:1 ! name", "HP:1"),
        (lambda c: x.tag_block(c, "s"), "u<s> v\nw </s>", "v\nw"), (lambda c: x.tag_block(c, "s"), "none", None), (x.without_ansi, "\x1b[31mred\x1b[0m", "red"), (x.normalize_na, "N/A", None), (x.normalize_na, "-", "-"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_nested(spark):
    assert one(spark, "MIM:138670|HGNC:HGNC:5|Ensembl:E1|MIM:2|bad", n.key_values) == {"MIM": "2", "HGNC": "HGNC:5", "Ensembl": "E1"}
    assert one(spark, "-", n.key_values) == {} and one(spark, None, n.key_values) == {}
    assert one(spark, "Arsenic^D001151^MESH|Cadmium^D002104^MESH| ", lambda c: n.split_entries(c, least=2)) == [["Arsenic", "D001151", "MESH"], ["Cadmium", "D002104", "MESH"]]
    assert one(spark, ["UMLS:C1", "x", "umls:C2"], lambda c: n.with_prefix(c, "UMLS:"), "array<string>") == ["C1"]
    assert one(spark, ["HP:1 ! a", "X:2"], lambda c: n.parents(c, "HP:"), "array<string>") == "HP:1"
    assert one(spark, ['"a b" EXACT [x]', 'plain "q'], n.synonym_texts, "array<string>") == "a b|plain "
    assert one(spark, None, lambda c: n.overlaps(c, ["a"]), "array<string>") is False


def test_choosing_rows(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    assert {(r.k, r.v) for r in rows.keep_first(df, ["k"], ["o"]).collect()} == {("a", "x"), (None, "m")}
    assert {(r.k, r.v) for r in rows.keep_last(df, ["k"], ["o"]).collect()} == {("a", "y"), (None, "n")}
    base = spark.createDataFrame([("1", "old"), ("", "blank")], "k string, a string")
    new = spark.createDataFrame([("1", "new", "b1"), ("2", "c", "b2"), (None, "d", "b3")], "k string, a string, b string")
    assert {tuple(r) for r in rows.merge_upsert(base, new, "k").collect()} == {("1", "old", "b1"), ("", "blank", None), ("2", "c", "b2"), (None, "d", "b3")}
    m = spark.createDataFrame([(1, t) for t in range(10)], "c int, t int")
    assert sorted(r.t for r in rows.first_and_last(m, "c", "t", 4).collect()) == [0, 7, 8, 9]
    assert rows.ensure_columns(df, {"z": "int", "k": "string"}).columns == ["z", "k", "o", "v"]


def test_fisher_is_exact(spark):
    cases = [(8, 10, 9, 16), (0, 5, 5, 20), (5, 5, 5, 20), (1, 1, 1, 1), (3, 300, 40, 3000), (30, 300, 40, 3000), (40, 300, 40, 3000), (0, 0, 0, 5)]
    got = with_fisher(spark.createDataFrame(cases, "a long, s long, t long, n long"), "a", "s", "t", "n", "p").collect()
    for r in got:
        exact = Fraction(sum(comb(r.s, k) * comb(r.n - r.s, r.t - k) for k in range(r.a, min(r.s, r.t) + 1)), comb(r.n, r.t))
        assert r.p == pytest.approx(float(exact), rel=1e-9)


def test_pair_statistics_edges(spark):
    s = spark.createDataFrame([("d1", 1), ("d1", 1), ("d1", 2), (None, 3), ("d2", None)], "source_id string, doc long")
    t = spark.createDataFrame([("m", 1), ("m", 3)], "target_id string, doc long")
    r = pair_statistics(s, t, 3).collect()
    assert [(x.source_id, x.target_id, x.cooccurrence, x.enrichment) for x in r] == [("d1", "m", 1, 0.75)]
    assert pair_statistics(s.limit(0), t, 0).count() == 0


def test_cross_references_of_every_gene(spark, tmp_path):
    from weftline.plans.reference import QUERIES

    texts = ["MIM:1|HGNC:HGNC:5", "MIM:1,HGNC:HGNC:5,MIM:2", 'MIM:1|"HGNC:HGNC:5"', "HGNC:HGNC:5\tMIM:1", "HGNC:HGNC:5; MIM:1 / Ensembl:E1", "HGNC:HGNC:5|IMGT/GENE-DB:NO8", "-", " ", None]
    spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "row_id long, GeneID string, dbXrefs string").write.parquet(f"{tmp_path}/genes.parquet")
    got = {r.row_id: (r.hgnc, r.mim) for r in QUERIES["kv_map_expand"](spark, str(tmp_path)).collect()}
    assert got == {0: ("HGNC:5", "1"), 1: ("HGNC:5", "2"), 2: ("HGNC:5", "1"), 3: ("HGNC:5", "1"), 4: ("HGNC:5", "1"), 5: ("HGNC:5", None), 6: (None, None), 7: (None, None), 8: (None, None)}
