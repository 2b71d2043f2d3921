import os

import pytest

import __spark_entry__ as entry
from verify import cell, views

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 4, 5, 6, 7)} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["slim_terms", "keep_first", "edge_resolution", "merge_upsert", "nested_cross", "degree_outliers", "p4_nodes", "p5_found", "p5_profile", "p6_found", "p7_found"])
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*cols).collect())
    cur = views(SMALL).execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["p_brand", "n_orders", "label"] and df.count() > 0
