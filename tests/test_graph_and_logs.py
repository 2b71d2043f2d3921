from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.graph import algo, build, export
from weftline.graph.catalog import Catalog, violations
from weftline.graph.components import connected_components
from weftline.graph.mapping import EdgeMapping, NodeMapping, active, parse_mappings, resolve_env, validate
from weftline.metrics import graph as gm
from weftline.metrics import tables as tm
from weftline.streaming import logs


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "genes": spark.createDataFrame([("1", "A", "MIM:5|HGNC:7", "x"), ("2", "B", "-", "x"), ("", "none", "", "x"), ("3", "C", None, "other")], "gid string, symbol string, refs string, kind string"),
        "more": spark.createDataFrame([("A", "desc a", "90"), ("D", "desc d", "91"), (None, "desc e", "92")], "symbol string, note string, gid string"),
        "pairs": spark.createDataFrame([("A", "B", "0.5"), ("A", "zz", "0.9"), ("B", "D", None)], "a string, b string, score string"),
    }


NODES = [
    NodeMapping("genes", "Gene", "genes", "gid", {"gid": "id", "symbol": "symbol"}, filter_column="kind", filter_value="x", compound={"refs": {"MIM": "mim"}}),
    NodeMapping("notes", "Gene", "more", "gid", {"symbol": "symbol", "note": "note"}, merge_on="symbol"),
]
EDGES = [EdgeMapping("links", "linked", "pairs", "a", "Gene", "symbol", "b", "Gene", "symbol", {"score": "weight"}, inverse="linkedBack")]


def test_nodes_merge_and_edges(spark, tables, tmp_path):
    nodes = build.build_nodes(tables, NODES).cache()
    got = {r.id: r.props for r in nodes.collect()}
    assert got["gene_1"] == {"id": ["1"], "symbol": ["A"], "mim": ["5"], "note": ["desc a"]}
    assert set(got) == {"gene_1", "gene_2", "gene_91", "gene_92"} and got["gene_92"] == {"note": ["desc e"]}
    edges = build.build_edges(tables, EDGES, nodes)
    e = {(r.rel_type, r.start_id, r.end_id, r.props.get("weight")) for r in edges.collect()}
    assert e == {("linked", "gene_1", "gene_2", "0.5"), ("linkedBack", "gene_2", "gene_1", "0.5"), ("linked", "gene_2", "gene_91", None), ("linkedBack", "gene_91", "gene_2", None)}
    assert build.valid_edges(edges, nodes.where("id <> 'gene_91'")).count() == 2
    assert {tuple(r) for r in build.relation_ends(edges, nodes).collect()} == {("linked", "Gene", "Gene"), ("linkedBack", "Gene", "Gene")}
    names = export.write_graph(nodes, edges, str(tmp_path))
    assert names == {"Gene": ["id", "mim", "note", "symbol"]}
    assert spark.read.option("header", "true").csv(f"{tmp_path}/nodes_Gene.csv").columns[0] == "id"
    s = export.cypher_script(names, {"linked": ("Gene", "Gene", ["weight"])})
    assert "CREATE INDEX ON :`Gene`(id);" in s and "MATCH (a:`Gene` {id: row.start_id})" in s and "[:`linked` {`weight`: row.`weight`}]" in s


def test_mappings(tables):
    assert resolve_env({"key_env": "K", "url": "http://${H}/x", "l": [{"u_env": "NO"}]}, {"K": "v", "H": "h"}) == {"key": "v", "url": "http://h/x", "l": [{"u": None}]}
    m = parse_mappings({"a": {"node_type": "T", "table": "genes", "id_column": "gid"}, "b": None, "c": {"kind": "relationship", "rel_type": "r", "table": "no", "start_column": "a", "start_type": "T", "start_property": "p", "end_column": "b", "end_type": "T", "end_property": "p"}})
    assert [x.name for x in active(m, {"genes"})] == ["a"] and active(m, {"genes", "no"}, {"a"})[0].name == "c"
    bad = validate(NODES + EDGES, {"Gene"}, {"linked"}, {"id", "symbol", "weight"}, {k: v.columns for k, v in tables.items() if k != "more"})
    assert bad == ["notes: no table more", "notes: unknown property note", "links: unknown relation linkedBack"]


OWL_TEXT = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<owl:Class rdf:about="http://x#Thing1"/><owl:Class rdf:about="http://x#Gene"><rdfs:subClassOf rdf:resource="http://x#Thing1"/></owl:Class>
<owl:Class rdf:about="http://x#TF"><owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection"><rdf:Description rdf:about="http://x#Gene"/></owl:intersectionOf></owl:Class></owl:equivalentClass></owl:Class>
<owl:ObjectProperty rdf:about="http://x#binds"><rdfs:domain rdf:resource="http://x#TF"/><rdfs:range rdf:resource="http://x#Gene"/><owl:inverseOf rdf:resource="http://x#boundBy"/></owl:ObjectProperty>
<owl:DatatypeProperty rdf:about="http://x#score"><rdfs:range rdf:resource="http://www.w3.org/2001/XMLSchema#double"/></owl:DatatypeProperty></rdf:RDF>"""


def test_catalog(spark, tmp_path):
    (tmp_path / "o.rdf").write_text(OWL_TEXT)
    c = Catalog.read(str(tmp_path / "o.rdf"))
    assert c.classes["TF"] == {"Gene"} and c.objects["binds"] == ({"TF"}, {"Gene"}, "boundBy") and c.data == {"score": "double"}
    with pytest.raises(ValueError):
        c.add_class("Gene")
    c.add_class("Drug", "Thing1")
    c.add_object_property("treats", "Drug", "Gene")
    cl = algo.closure(c.class_table(spark))
    assert {tuple(r) for r in cl.collect()} == {("Gene", "Thing1"), ("TF", "Gene"), ("TF", "Thing1"), ("Drug", "Thing1")}
    nodes = spark.createDataFrame([("t", "TF"), ("g", "Gene"), ("d", "Drug")], "id string, node_type string")
    edges = spark.createDataFrame([("binds", "t", "g"), ("binds", "g", "t"), ("binds", "d", "d"), ("binds", "t", "nowhere")], "rel_type string, start_id string, end_id string")
    dr = c.object_table(spark).select(F.col("name").alias("rel_type"), "domain", "range")
    assert {tuple(r) for r in violations(edges, nodes, dr, cl).collect()} == {("binds", 3)}
    c.remove("Drug")
    assert c.objects["treats"][0] == set() and "Drug" not in c.classes
    assert ("relation", "treats", True, False) in {tuple(r) for r in c.listing(spark, nodes, edges).collect()}


def test_graph_measures(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("z", "z"), (None, "q")], "start_id string, end_id string")
    assert {(r.node, r.component) for r in connected_components(e.toDF("a", "b")).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")}
    assert {tuple(r) for r in algo.degrees(e.where("start_id = 'z'")).collect()} == {("z", 2)}
    d = algo.bfs_depth(e.toDF("src", "dst"), "a")
    assert {tuple(r) for r in d.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert algo.component_summary(e.limit(0).selectExpr("start_id as id"), e.limit(0)).first().n_nodes == 0
    r = gm.duplicates(e.union(e), ["start_id", "end_id"]).first()
    assert (r.n_rows, r.n_duplicates, r.duplicate_rate) == (12, 6, 0.5)
    h = spark.createDataFrame([("r", 1, 2), ("r", 1, 3), ("r", 1, 10), ("q", 1, 2), ("q", None, 2)], "rel_type string, start_id int, end_id int")
    assert {tuple(r) for r in gm.degree_outliers(h, 0.5).collect()} == {("r", 1.0, 1), ("q", 1.5, 1)}
    v = spark.createDataFrame([("a", "T"), ("i", "T"), ("i", "U"), (None, "U")], "id string, node_type string")
    assert {tuple(r) for r in gm.orphan_rate(v, e).collect()} == {("T", 2, 1, 0.5), ("U", 2, 1, 0.5)}
    assert tuple(algo.component_summary(v, e).first()) == (7, 4, 3, 3 / 7)  # a-b-c, x-y, z, i
    pair = spark.createDataFrame([(" a ", "b"), ("a", ""), (None, "b"), ("a", "q")], "s string, e string")
    known = spark.createDataFrame([("a ",), ("b",), ("",)], "k string")
    assert tuple(gm.resolution_rate(pair, "s", "e", known, known).first()) == (4, 1, 0.25) and gm.resolution_rate(pair.limit(0), "s", "e", known, known).first().resolution_rate is None
    assert tuple(gm.match_rate(pair, "s", known).first()) == (3, 1.0) and gm.match_rate(pair, "nowhere", known).first().match_rate is None
    refs = gm.references(spark.createDataFrame([("a", "x ", None), ("b", "x", "y"), ("c", "", "x"), (None, "x", "")], "id string, r1 string, r2 string"), ["r1", "r2"])
    assert tuple(gm.reference_resolution(refs).first()) == (4, 3, 0.75) and tuple(gm.shared_reference_pairs(refs).first()) == (1, 3)
    assert gm.reference_resolution(refs.limit(0)).first().resolution_rate is None
    now = spark.createDataFrame([("a", 5), ("n", 1), (None, 2)], "k string, n int")
    gone = gm.count_deltas(now, spark.createDataFrame([("a", 9), ("old", 4), (None, 2)], "k string, n int"), "k")
    assert {(r.k, r.delta) for r in gone.collect()} == {("a", -4), ("n", 1), (None, 0)} and tuple(gm.largest_delta(gone).first()) == (2, 4) and tuple(gm.largest_delta(gone.limit(0)).first()) == (0, 0)
    assert gm.property_completeness({"G": ["a", "b"]}, {"G": ["a"]}) == [("G", ["b"], 0.5)]
    k = gm.known_pairs(spark.createDataFrame([("G1", "x, 123456 (3); y, 654321 (2); z, 111111 (3)"), ("", "222222 (3)")], "gene string, phenotypes string"))
    assert {tuple(r) for r in k.collect()} == {("G1", "123456"), ("G1", "111111")}
    assert tm.schema_conformance({"t": ["a", "b"], "u": ["c"]}, {"t": spark.createDataFrame([(1, 2)], "a int, z int")}) == [("t", ["b"], ["z"]), ("u", ["c"], [])]
    assert tm.null_rates(e.limit(0), ["start_id"]).count() == 0 and tm.duplication(e.limit(0), "start_id").first().duplication_rate == 0.0


def test_triples(spark):
    b, t = "http://x#", build.RDF + "type"
    rows = [(b + "i", t, build.OWL + "NamedIndividual", False), (b + "i", t, b + "Gene", False), (b + "i", t, b + "TF", False), (b + "j", t, build.OWL + "NamedIndividual", False), (b + "j", t, b + "Drug", False), (b + "i", b + "name", 'n"1', True), (b + "i", b + "binds", b + "j", False), (b + "i", b + "binds", b + "nobody", False), (b + "i", build.RESERVED[1] + "label", "l", True)]
    tr = spark.createDataFrame(rows, "s string, p string, o string, o_is_literal boolean")
    assert {(r.id, r.node_type, str(r.props)) for r in build.triple_nodes(tr).collect()} == {("i", "Gene", "{'name': ['n\"1']}"), ("i", "TF", "{'name': ['n\"1']}"), ("j", "Drug", "{}")}
    assert [tuple(r) for r in build.triple_edges(tr).collect()] == [("binds", "i", "j")]
    onto = tr.union(spark.createDataFrame([("http://o/kg", t, build.OWL + "Ontology", False)], tr.schema))
    classes = spark.createDataFrame([("http://b#C", t, build.OWL + "Class", False), ("http://slash/i", t, build.OWL + "NamedIndividual", False)], tr.schema)
    assert build.main_namespace(onto).first().namespace == "http://o/kg#" and build.main_namespace(classes).first().namespace is None
    ends = build.relation_ends(spark.createDataFrame([("r", "a", "?"), ("r", "?", "b"), ("s", "?", "b")], "rel_type string, start_id string, end_id string"), spark.createDataFrame([("a", "A"), ("b", "B")], "id string, node_type string"))
    assert [tuple(x) for x in ends.collect()] == [("r", "A", "B")]
    assert build.match(tr, s=b + "i", p=t).count() == 3 and build.main_namespace(tr).first().namespace == b
    assert '<http://x#i> <http://x#name> "n\\"1" .' in {r.value for r in export.ntriples(tr).collect()}


def test_logs(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "v string").select(f("v").alias("r")).first().r
    assert [one(v, logs.next_step) for v in ("a <execute>x", "<solution>y</solution>", "<think>", "plain", "<execute>x</execute> <solution>y", "<think>use <execute> later</think>", "<think>no <execute>", None)] == ["execute", "end", "generate", "generate", "end", "generate", "execute", None]
    assert one("plain", lambda c: logs.next_step(c, F.lit(2))) == "end" and one("plain", lambda c: logs.next_step(c, F.lit(1))) == "generate"
    assert one(" <think>a <execute></think><solution>b ", logs.repair_tags) == "<think>a <execute></think><solution>b </solution>" and one("<execute> x <", logs.pending_code) == "x <"
    assert [one(v, logs.solution) for v in ("<think>secret</think>answer", "<think>only</think>", "x<solution> s </solution>", "ERROR: e")] == ["answer", "<think>only</think>", "s", "ERROR: e"]
    assert [one(v, logs.code_language) for v in ("# R script\nx", "# Bashing numbers", "# Bash script", "#!CLI ls")] == ["r", "python", "bash", "bash"] and one("#!R\nx ", logs.without_marker) == "x"
    assert one('{"usage": {"inputTokens": 3}, "outputTokens": 4, "prompt_eval_count": 0}', lambda c: logs.usage(c)["total"]) == 7 and one('{"prompt_eval_count": 9}', lambda c: logs.usage(c)["input"]) == 9 and one('{"usage": {"input_tokens": 0}}', lambda c: logs.usage(c)["input"]) == 0
    assert one("<execute>x", logs.repair_tags) == "<execute>x</execute>" and one("#!R\nx", logs.code_language) == "r" and one("print(1)", logs.code_language) == "python"
    assert one("no json", logs.usage).total is None
    assert one("TOOLS: [1, x, 3]", lambda c: logs.index_list(c, "TOOLS")) == [1, 3]
    assert one('see {"nodes": [{"id": "a"}], "links": []} ok', logs.embedded_graph).nodes[0].id == "a"
    f = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, True, False, True, None])], "run int, i int, failed boolean")
    assert [r.consecutive_failures for r in logs.failure_streaks(f, "run", "i", F.col("failed")).orderBy("i").collect()] == [1, 2, 0, 1, 0]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 5, i % 60), i % 3, ["click", "view", "buy"][i % 3], float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, logs.EVENT)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in logs.windowed_usage(df, ["click", "buy"]).collect()}
    s = logs.windowed_usage(logs.event_stream(spark, str(tmp_path / "in"), max_files=1), ["click", "buy"], late="10 hours")
    q = s.writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("usage").collect()} == batch


def test_nodes_below_the_greatest_depth_are_an_error(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    with pytest.raises(RuntimeError, match="deeper than 2"):
        algo.bfs_depth(e, "a", max_depth=2)
    assert {tuple(r) for r in algo.bfs_depth(e, "a", max_depth=3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
