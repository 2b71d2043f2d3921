"""Writing graphs: one table per type, an import script, reports."""

from __future__ import annotations

import json
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import write_small

CSV = {"header": "true", "escape": '"', "quote": '"'}


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def wide_nodes(nodes: DataFrame, node_type: str, properties: list[str]) -> DataFrame:
    """One row per node of a type: id, then its properties in sorted order, first values. A
    property that is itself called id gives way to the node's id."""
    t = nodes.where(F.col("node_type") == node_type)
    return t.select("id", *[F.try_element_at(F.col("props")[p], F.lit(1)).alias(p) for p in sorted(properties) if p.lower() != "id"])


def property_names(nodes: DataFrame) -> dict[str, list[str]]:
    """Property names per node type: catalog-sized."""
    rows = nodes.select("node_type", F.explode_outer(F.map_keys("props")).alias("p")).groupBy("node_type").agg(F.array_sort(F.collect_set("p")).alias("ps")).collect()
    return {r.node_type: list(r.ps) for r in rows}


def relation_properties(edges: DataFrame, ends: DataFrame) -> dict[str, tuple[str, str, list[str]]]:
    """Per relation its end types (graph.build.relation_ends) and property names: catalog-sized."""
    ps = edges.select("rel_type", F.explode_outer(F.map_keys("props")).alias("p")).groupBy("rel_type").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    return {r.rel_type: (r.start_type, r.end_type, list(r.ps)) for r in ends.join(ps, "rel_type").collect()}


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> dict[str, list[str]]:
    """nodes_<Type>.csv and edges_<rel>.csv folders, the whole graph as Parquet partitioned
    by type, and import.cypher; returns the property names by type."""
    names = property_names(nodes)
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{folder}/node.parquet")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{folder}/edge.parquet")
    for t, ps in names.items():
        wide_nodes(nodes, t, ps).write.mode("overwrite").options(**CSV).csv(f"{folder}/nodes_{t}.csv")
    rels = {r.rel_type: sorted(r.ps) for r in edges.select("rel_type", F.explode_outer(F.map_keys("props")).alias("p")).groupBy("rel_type").agg(F.collect_set("p").alias("ps")).collect()}
    for r, ps in rels.items():
        edges.where(F.col("rel_type") == r).select("start_id", "end_id", *[F.col("props")[p].alias(p) for p in ps]).write.mode("overwrite").options(**CSV).csv(f"{folder}/edges_{r}.csv")
    return names


def cypher_script(node_props: dict[str, list[str]], relations: dict[str, tuple[str, str, list[str]]], folder: str = ".") -> str:
    """Text of an import script: indexes, a block per node type, a block per relation that
    matches its ends by label. ``relations`` maps a name to its end types and properties."""
    q = lambda s: "`" + s.replace("`", "``") + "`"
    out = ["// indexes"]
    out += [f"CREATE INDEX ON :{q(t)}(id);" for t in sorted(node_props)]
    out.append("\n// nodes")
    for t in sorted(node_props):
        fields = ", ".join(f"{q(p)}: row.{q(p)}" for p in ["id", *(p for p in sorted(node_props[t]) if p.lower() != "id")])
        out.append(f'LOAD CSV FROM "{folder}/nodes_{t}.csv" WITH HEADER AS row CREATE (:{q(t)} {{{fields}}});')
    out.append("\n// edges")
    for r in sorted(relations):
        a, b, ps = relations[r]
        fields = ", ".join(f"{q(p)}: row.{q(p)}" for p in sorted(ps))
        out.append(f'LOAD CSV FROM "{folder}/edges_{r}.csv" WITH HEADER AS row MATCH (a:{q(a)} {{id: row.start_id}}), (b:{q(b)} {{id: row.end_id}}) CREATE (a)-[:{q(r)}{" {" + fields + "}" if fields else ""}]->(b);')
    return "\n".join(out) + "\n"


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): lines of N-Triples for a text sink."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    o = F.when(F.col("o_is_literal"), F.concat(F.lit('"'), esc(F.col("o")), F.lit('"'))).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def write_rdf(nodes: DataFrame, edges: DataFrame, path: str, base: str) -> None:
    """The graph as named individuals of one RDF/XML file under the folder ``path``: types,
    property values as literals, edges as resources, one element a statement, so that
    nothing is gathered per node. One file is one task's work, so this is for graphs
    of an ontology's size; ``ntriples`` writes any."""
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    iri = lambda c: F.concat(F.lit(f"{base}#"), xml(c))
    part = lambda name, inside: F.concat(F.lit("<kg:"), name, inside)
    kinds = nodes.select("id", F.concat(F.lit('<rdf:type rdf:resource="'), iri(F.col("node_type")), F.lit('"/>')).alias("t"))
    values = nodes.select("id", F.explode("props").alias("p", "vs")).select("id", "p", F.explode("vs").alias("v")).where("v is not null").select("id", part(F.col("p"), F.concat(F.lit(">"), xml(F.col("v")), F.lit("</kg:"), F.col("p"), F.lit(">"))).alias("t"))
    links = edges.where("end_id is not null").select(F.col("start_id").alias("id"), part(F.col("rel_type"), F.concat(F.lit(' rdf:resource="'), iri(F.col("end_id")), F.lit('"/>'))).alias("t"))
    links = links.join(nodes.select("id").distinct(), "id", "left_semi")
    statements = kinds.unionByName(values).unionByName(links).select("id", "t").distinct()
    one = statements.select(F.lit(1).alias("o"), F.concat(F.lit('<owl:NamedIndividual rdf:about="'), iri(F.col("id")), F.lit('">'), "t", F.lit("</owl:NamedIndividual>")).alias("value"))
    head = f'<rdf:RDF xml:base="{base}" xmlns:kg="{base}#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n<owl:Ontology rdf:about="{base}"/>'
    frame = nodes.sparkSession.createDataFrame([(0, head), (2, "</rdf:RDF>")], "o int, value string")
    frame.unionByName(one).repartition(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Sorted distinct lines, gzipped."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").option("compression", "gzip").text(path)


def write_report(metrics: DataFrame, path: str, run: dict | None = None) -> None:
    """A JSON report of metric rows: a metric table is catalog-sized."""
    rows = [json.loads(x) for x in metrics.toJSON().toLocalIterator()]
    write_small(metrics.sparkSession, path, json.dumps({**(run or {}), "metrics": rows}, indent=2, sort_keys=True))


def with_json(template: str, placeholder: str, name: str, records: DataFrame) -> str:
    """A page whose placeholder is replaced, once, by a constant that holds the records: a
    catalog, small by itself. A template without the placeholder is an error."""
    if placeholder not in template:
        raise ValueError(f"no {placeholder!r} in the template")
    rows = [json.loads(x) for x in records.toJSON().toLocalIterator()]
    return template.replace(placeholder, f"const {name} = {json.dumps(rows, ensure_ascii=False, indent=2)};", 1)
