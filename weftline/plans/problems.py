"""The pN_ queries of the core problems: reading the tables, then the operator."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import is_blank, micros
from weftline.operators import hierarchy as hi
from weftline.operators.orphans import orphans
from weftline.operators.peg import NUMBERS, SYNONYMS, XREFS, split_values, term_ids, value_rows
from weftline.operators.profile import column_profile, different_loads, format_violations, load_distances, load_statistics, load_store, unusual_loads
from weftline.operators.skew import count_rows, max_of, min_of, salted_aggregate
from weftline.plans.tables import table
from weftline.storage import cut, session_path

#: Tables with a hierarchy: id column, prefix of its ids.
HIERARCHIES = {"disease_nodes": ("mondo_id", "MONDO"), "phenotype_nodes": ("hp_id", "HP")}


def parent_ids(c: Column | str, prefix: str) -> Column:
    """All ids with this prefix in a text, written as PREFIX:0000000, in order."""
    return F.transform(split_values(c, term_ids(prefix)), lambda v: v["value"])


def term_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(child, parent) of all rows of both term tables, and their terms (node)."""
    links, nodes = None, None
    for name, (key, prefix) in HIERARCHIES.items():
        t = table(spark, d, name)
        x = t.select(F.col(key).alias("child"), F.explode(parent_ids("is_a", prefix)).alias("parent"))
        n = t.select(F.col(key).alias("node"))
        links, nodes = (x, n) if links is None else (links.unionByName(x), nodes.unionByName(n))
    return links, nodes


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    links, _ = term_links(spark, d)
    return hi.cycles(links).select(F.col("node").alias("term_id"), "cycle_id")


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its place: depths, number of paths, roots."""
    links, nodes = term_links(spark, d)
    h = hi.hierarchy(links, nodes)
    return h.select(F.col("node").alias("term_id"), "cycle_id", "depth_min", "depth_max", F.col("n_paths").cast("long").alias("n_paths"), F.array_join("roots", "|").alias("roots"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every full path of every term, from a root down to it."""
    links, nodes = term_links(spark, d)
    return hi.paths(links, nodes).select(F.col("node").alias("term_id"), "path")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    links, nodes = term_links(spark, d)
    return hi.ancestors(links, nodes).select(F.col("ancestor").alias("term_id"), F.col("node").alias("descendant_id"))


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_paths": p1_paths, "p1_descendants": p1_descendants}
SQL: dict[str, str] = {}


# 4: per-node results of graph_edges


def edge_ends(spark: SparkSession, d: str) -> DataFrame:
    """Two rows per edge: (side, node_id, edge_id, rel_type, loaded_at)."""
    e = table(spark, d, "graph_edges")
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("node_id")) for s in ("start", "end")])
    return e.select("edge_id", "rel_type", "loaded_at", F.explode(ends).alias("x")).select("x.side", "x.node_id", "edge_id", "rel_type", "loaded_at")


def node_results(spark: SparkSession, d: str) -> DataFrame:
    """(side, node_id, degree, by_rel_type, first_loaded_at, last_loaded_at)."""
    by_type = salted_aggregate(edge_ends(spark, d), ["side", "node_id"], F.col("edge_id"), [count_rows("n"), min_of("first", "loaded_at"), max_of("last", "loaded_at")], within=["rel_type"])
    # Partitioned by (side, node_id) already; rel_type has a bounded few values per node.
    return by_type.groupBy("side", "node_id").agg(
        F.sum("n").alias("degree"), F.array_sort(F.collect_list(F.struct(F.coalesce("rel_type", F.lit("")).alias("rel_type"), "n"))).alias("by_rel_type"),
        F.min("first").alias("first_loaded_at"), F.max("last").alias("last_loaded_at"))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    counts = F.array_join(F.transform("by_rel_type", lambda x: F.concat(x["rel_type"], F.lit("="), x["n"].cast("string"))), ";")
    return node_results(spark, d).select("side", "node_id", "degree", counts.alias("by_rel_type"), micros("first_loaded_at").alias("first_us"), micros("last_loaded_at").alias("last_us"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    degrees = cut(salted_aggregate(edge_ends(spark, d), ["side", "node_id"], F.col("edge_id"), [count_rows("degree")]), "degrees")
    # Every row has one start, blank or not.
    n = degrees.where("side = 'start'").agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    return degrees.where((F.col("degree") * 50 >= n) & ~is_blank("node_id")).select("side", "node_id")


# 5: profiles of the node tables

FORMATS = {
    ("disease_nodes", "umls_cui"): "C[0-9]{7}",
    ("chemical_nodes", "inchikey"): "[A-Z]{14}-[A-Z]{10}-[A-Z]",
    ("disease_nodes", "definition"): "[A-Z][A-Za-z0-9 ,;:()'/.-]{18,}\\.",
}
UNUSUAL = {
    "nulls": [("disease_nodes", "umls_cui"), ("disease_nodes", "definition"), ("chemical_nodes", "inchikey")],
    "length": [("disease_nodes", "definition")],
    "repeats": [("disease_nodes", "umls_cui"), ("chemical_nodes", "inchikey")],
}


def store_path(spark: SparkSession, d: str, name: str) -> str:
    """The value counts of a folder of tables, one place for all queries of a session: what
    the first has counted, the next only compares with the tables."""
    return f"{session_path(spark)}/value-counts-{name}-{hashlib.sha1(d.encode()).hexdigest()[:16]}"


def digest(value: Column) -> Column:
    return F.unhex(F.md5(value)).alias("digest")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Violations are tested once per distinct value of the maintained counts and
    joined back to the rows that hold it; loads are judged from the counts alone."""
    cols = {"disease_nodes": ["definition", "umls_cui"], "chemical_nodes": ["inchikey"]}
    tables = {t: (table(spark, d, t), c) for t, c in cols.items()}
    counts = load_store(tables, store_path(spark, d, "found")).read()
    bad = format_violations(counts, FORMATS)
    rows = None
    for t, (df, cs) in tables.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in cs])
        x = df.select("row_id", F.lit(t).alias("table_name"), F.explode(pairs).alias("p")).where("p.value is not null").select("row_id", "table_name", "p.column_name", digest(F.col("p.value")))
        rows = x if rows is None else rows.unionByName(x)
    # Values are joined by a digest of 128 bits, so that no text is moved.
    bad = bad.select("table_name", "column_name", digest(F.col("value")))
    fmt = rows.join(bad, ["table_name", "column_name", "digest"], "left_semi").select("table_name", "column_name", F.lit("format").alias("kind"), F.col("row_id").alias("ref_id"))
    loads = unusual_loads(counts, UNUSUAL).select("table_name", "column_name", "kind", F.col("load_no").cast("long").alias("ref_id"))
    return fmt.unionByName(loads)


NODE_TABLES = ("disease_nodes", "phenotype_nodes", "genes", "chemical_nodes", "graph_nodes")


def every_count(spark: SparkSession, d: str) -> tuple[DataFrame, set[tuple[str, str]]]:
    """Counts of every column of the node tables, one delta per load, and the columns of numbers."""
    tables = {t: table(spark, d, t) for t in NODE_TABLES}
    numbers = {(t, c) for t, df in tables.items() for c, kind in df.dtypes if kind in ("int", "bigint")}
    return load_store({t: (df, df.columns) for t, df in tables.items()}, store_path(spark, d, "all")).read(), numbers


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of every node table; n_format is null where there is no pattern."""
    counts, numbers = every_count(spark, d)
    p = column_profile(counts, FORMATS, numbers)
    return p.withColumn("null_rate", F.round("null_rate", 6)).withColumn("entropy_bits", F.round("entropy_bits", 6))


def p5_loads(spark: SparkSession, d: str) -> DataFrame:
    """Every column and load beside the other loads; graph_nodes has no loads and is one of its own."""
    return load_statistics(every_count(spark, d)[0])


def p5_distances(spark: SparkSession, d: str) -> DataFrame:
    """p5_loads with distances, divergences and entropies of values and of their shapes."""
    return load_distances(every_count(spark, d)[0])


def p5_unusual(spark: SparkSession, d: str) -> DataFrame:
    """Loads that differ, over every column. graph_nodes has no loads."""
    return different_loads(p5_distances(spark, d))


# 6: references of graph_edges to nodes that are not there


def edge_orphans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "graph_edges")
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("key")) for s in ("start", "end")])
    refs = e.select(F.col("edge_id").alias("ref_id"), F.col("loaded_at").alias("at"), F.explode(ends).alias("x")).select("ref_id", "x.side", "x.key", "at")
    parents = table(spark, d, "graph_nodes").select(F.col("id").alias("key"), F.col("created_at").alias("born"), F.col("deleted_at").alias("died"))
    return orphans(refs, parents)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return edge_orphans(spark, d).select(F.col("ref_id").alias("edge_id"), "side", "kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per side, kind and month of loaded_at."""
    month = F.date_format(F.timestamp_micros(F.nullif("at", F.lit(-(2**63)))), "yyyy-MM")
    return edge_orphans(spark, d).groupBy("side", "kind", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


# 7: one row per packed value

PACKED = {("disease_nodes", "synonyms"): SYNONYMS, ("genes", "dbXrefs"): XREFS, ("ctd_interactions", "PubMedIDs"): NUMBERS, ("disease_nodes", "is_a"): term_ids("MONDO")}


def packed_values(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, column_name, row_id, pos, value, quoted, flag) of every packed column."""
    out = None
    for (t, c), g in PACKED.items():
        x = value_rows(table(spark, d, t).select("row_id", F.col(c).alias("packed")), "packed", g)
        x = x.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "row_id", "pos", "value", "quoted", "flag")
        out = x if out is None else out.unionByName(x)
    return out


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values(spark, d).where("pos is not null").select("table_name", "column_name", "row_id", "pos", "value")


def p7_flags(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose packed text was not read without trouble."""
    return packed_values(spark, d).where("flag is not null and coalesce(pos, 1) = 1").select("table_name", "column_name", "row_id", "flag")


QUERIES |= {
    "p4_found": p4_found, "p4_nodes": p4_nodes, "p5_found": p5_found, "p5_profile": p5_profile, "p5_loads": p5_loads, "p5_distances": p5_distances, "p5_unusual": p5_unusual,
    "p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p7_flags": p7_flags,
}
