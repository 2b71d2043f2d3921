"""Nodes and edges from mapped tables.

Nodes are (id, node_type, props map<string, array<string>>); a property keeps
all its values, in the order of the mappings. Edges are (rel_type, start_id,
end_id, props map<string, string>). Ends are resolved by equi-joins against one
long table (node_type, property, value, id), built once for all relations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import nested as n
from weftline.functions import text as x
from weftline.graph.mapping import EdgeMapping, NodeMapping
from weftline.operators.rows import keep_first


def node_id(node_type: str, value: Column | str) -> Column:
    return F.concat(F.lit(node_type.lower() + "_"), x.slug(value))


def _filtered(df: DataFrame, m: NodeMapping | EdgeMapping) -> DataFrame:
    return df.where(F.col(m.filter_column).cast("string") == m.filter_value) if m.filter_column else df


def mapped_rows(df: DataFrame, m: NodeMapping) -> DataFrame:
    """(id, node_type, key, prop, value, ord): one row per property value of a mapping's
    nodes, and one without property per node. Blank ids make no node, blank values no property."""
    df = _filtered(df, m).where(~x.is_blank(F.col(m.id_column).cast("string")))
    if m.unique_rows:
        order = ["_ord"] if "_ord" in df.columns else [c for c, t in df.dtypes if not t.startswith("map")]
        df = keep_first(df.withColumn("_id", node_id(m.node_type, F.col(m.id_column).cast("string"))), ["_id"], order)
    merge = next((c for c, p in m.properties.items() if p == m.merge_on), None)
    key = F.nullif(x.strip(F.col(merge).cast("string")), F.lit("")) if merge else F.lit(None).cast("string")
    pairs = [F.struct(F.lit(p).alias("prop"), F.col(c).cast("string").alias("value"), F.lit(i).alias("ord")) for i, (c, p) in enumerate(m.properties.items())]
    for c, keys in m.compound.items():
        kv = n.key_values(c)
        pairs += [F.struct(F.lit(p).alias("prop"), kv[k].alias("value"), F.lit(100 + i).alias("ord")) for i, (k, p) in enumerate(keys.items())]
    pairs.append(F.struct(F.lit(None).cast("string").alias("prop"), F.lit(None).cast("string").alias("value"), F.lit(-1).alias("ord")))
    return df.select(node_id(m.node_type, F.col(m.id_column).cast("string")).alias("id"), F.lit(m.node_type).alias("node_type"), key.alias("key"), F.explode(F.array(*pairs)).alias("p")).select("id", "node_type", "key", "p.*").where("prop is null or trim(value) <> ''")


def build_nodes(tables: dict[str, DataFrame], mappings: Sequence[NodeMapping]) -> DataFrame:
    """All nodes, folding the mappings in their order: a mapping with ``merge_on`` adds its
    properties to nodes (of its type) that already have the key's value, and makes
    new nodes of the rest; without, rows of one id are one node."""
    values: DataFrame | None = None
    for k, m in enumerate(mappings):
        new = mapped_rows(tables[m.table], m).withColumn("rank", F.lit(k))
        if m.merge_on and values is not None:
            known = values.where((F.col("prop") == m.merge_on) & (F.col("node_type") == m.node_type)).groupBy(F.col("value").alias("key")).agg(F.min("id").alias("known"))
            new = new.join(known, "key", "left").withColumn("id", F.coalesce("known", "id")).drop("known")
        new = new.select("id", "node_type", "prop", "value", "ord", "rank")
        values = new if values is None else values.unionByName(new)
    # Values of one property in mapping order, each once.
    first = values.groupBy("id", "node_type", "prop", "value").agg(F.min(F.struct("rank", "ord")).alias("o"))
    lists = first.groupBy("id", "node_type", "prop").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda s: s["value"]).alias("vals"))
    pairs = F.filter(F.array_sort(F.collect_list(F.struct("prop", "vals"))), lambda p: p["prop"].isNotNull())
    return lists.groupBy("id", "node_type").agg(F.map_from_entries(pairs).alias("props"))


def node_properties(nodes: DataFrame) -> DataFrame:
    """(node_type, prop, value, id): the first value of each property, blank ones left out."""
    return nodes.select("node_type", "id", F.explode("props").alias("prop", "vals")).select("node_type", "prop", F.try_element_at("vals", F.lit(1)).alias("value"), "id").where(~x.is_blank("value"))


def build_edges(tables: dict[str, DataFrame], mappings: Sequence[EdgeMapping], nodes: DataFrame, any_type: bool = False) -> DataFrame:
    """All edges of the mappings. A value that several nodes hold gives an edge for each
    (many to many); rows with an unresolved end give none. ``any_type`` looks ends
    up among all node types, not only the declared one."""
    props = node_properties(nodes)
    out: DataFrame | None = None
    for m in mappings:
        def side(t: str, p: str, name: str) -> DataFrame:
            s = props.where(F.col("prop") == p) if any_type else props.where((F.col("prop") == p) & (F.col("node_type") == t))
            return s.select(F.col("value").alias(f"_{name}"), F.col("id").alias(f"{name}_id"))

        pairs = F.filter(F.array(*[F.struct(F.lit(p).alias("key"), F.col(c).cast("string").alias("value")) for c, p in m.properties.items()]) if m.properties else F.array().cast("array<struct<key:string,value:string>>"), lambda e: e["value"].isNotNull() & (e["value"] != ""))
        rows = _filtered(tables[m.table], m).select(x.strip(F.col(m.start_column).cast("string")).alias("_start"), x.strip(F.col(m.end_column).cast("string")).alias("_end"), F.map_from_entries(pairs).alias("props"))
        e = rows.join(side(m.start_type, m.start_property, "start"), "_start").join(side(m.end_type, m.end_property, "end"), "_end")
        e = e.select(F.lit(m.rel_type).alias("rel_type"), "start_id", "end_id", "props")
        if m.inverse:
            e = with_inverse(e, m.inverse)
        out = e if out is None else out.unionByName(e)
    return out


def with_inverse(edges: DataFrame, inverse: str) -> DataFrame:
    """The edges and their swapped copies under the inverse relation, properties kept."""
    swapped = edges.select(F.lit(inverse).alias("rel_type"), F.col("end_id").alias("start_id"), F.col("start_id").alias("end_id"), *[c for c in edges.columns if c not in ("rel_type", "start_id", "end_id")])
    return edges.unionByName(swapped)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "start_id"), "start_id", "left_semi").join(ids.withColumnRenamed("id", "end_id"), "end_id", "left_semi")


# The same from triples

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
OWL = "http://www.w3.org/2002/07/owl#"
RESERVED = (RDF, "http://www.w3.org/2000/01/rdf-schema#", OWL)


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the given parts; None matches anything."""
    for c, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            triples = triples.where(F.col(c) == v)
    return triples


def main_namespace(triples: DataFrame) -> DataFrame:
    """One row: the namespace of the graph. That is the IRI of its ontology (of several, the
    first), with a # at the end; without one, what precedes the last # in most
    individuals' IRIs (ties: the first), null where no IRI has a #."""
    typed = triples.where(F.col("p") == RDF + "type").select("s", "o").distinct()
    whole = F.when((F.col("o") == OWL + "Ontology"), F.when(F.endswith("s", F.lit("#")), F.col("s")).otherwise(F.concat("s", F.lit("#"))))
    part = F.when((F.col("o") == OWL + "NamedIndividual") & F.col("s").contains("#"), F.regexp_extract("s", r"(?s)^(.*#)", 1))
    c = typed.groupBy(whole.alias("whole"), part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.coalesce(F.min("whole"), F.min_by("part", F.when(F.col("part").isNotNull(), F.struct(-F.col("n"), F.col("part"))))).alias("namespace"))


def triple_nodes(triples: DataFrame) -> DataFrame:
    """(id, node_type, props) of the individuals: one row per class an individual has (a
    node of two classes is in both), with all its literal properties."""
    t = match(triples, p=RDF + "type")
    named = t.where(F.col("o") == OWL + "NamedIndividual").select("s").distinct()
    classes = t.where(~F.startswith("o", F.lit(OWL))).join(named, "s", "left_semi").select("s", x.local_name("o").alias("node_type")).distinct()
    lit = triples.where(F.col("o_is_literal") & ~x.starts_with_any("p", list(RESERVED)))
    bag = lit.select("s", x.local_name("p").alias("prop"), "o").distinct().groupBy("s", "prop").agg(F.array_sort(F.collect_list("o")).alias("vals")).groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "vals")))).alias("props"))
    return classes.join(bag, "s", "left").select(x.local_name("s").alias("id"), "node_type", F.coalesce("props", F.create_map().cast("map<string,array<string>>")).alias("props"))


def triple_edges(triples: DataFrame) -> DataFrame:
    """(rel_type, start_id, end_id) of object properties between individuals."""
    named = match(triples, p=RDF + "type", o=OWL + "NamedIndividual").select("s").distinct()
    e = triples.where(~F.col("o_is_literal") & ~x.starts_with_any("p", list(RESERVED)))
    e = e.join(named, "s", "left_semi").join(named.withColumnRenamed("s", "o"), "o", "left_semi")
    return e.select(x.local_name("p").alias("rel_type"), x.local_name("s").alias("start_id"), x.local_name("o").alias("end_id"))


def relation_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel_type, start_type, end_type): per relation the type of the first known start and,
    on its own, of the first known end, edges in the order of their ids; relations with a
    side that is never known are left out. A node of several types counts as the last one."""
    t = nodes.groupBy("id").agg(F.max("node_type").alias("node_type"))
    e = edges.join(t.select(F.col("id").alias("start_id"), F.col("node_type").alias("start_type")), "start_id", "left").join(t.select(F.col("id").alias("end_id"), F.col("node_type").alias("end_type")), "end_id", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("start_id", "end_id"))).alias(c)
    return e.groupBy("rel_type").agg(first("start_type"), first("end_type")).where("start_type is not null and end_type is not null")
