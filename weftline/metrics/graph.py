"""Quality of a graph and its ontology. A metric is a row:
metric(name, tier, subject, value) with a number as value; subject names the
type, relation or source it is about, or is empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_blank, strip
from weftline.graph import algo
from weftline.metrics.tables import rate


def metric(df: DataFrame, name: str, tier: int, value: Column, subject: Column | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.lit(tier).alias("tier"), (subject if subject is not None else F.lit("")).alias("subject"), value.cast("double").alias("value"))


# Ontology

def populated_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n_types, types): what has data, sorted."""
    a = nodes.agg(F.lit("node").alias("kind"), F.countDistinct("node_type").alias("n_types"), F.array_sort(F.collect_set("node_type")).alias("types"))
    b = edges.agg(F.lit("edge").alias("kind"), F.countDistinct("rel_type").alias("n_types"), F.array_sort(F.collect_set("rel_type")).alias("types"))
    return a.unionByName(b)


def set_rate(part: DataFrame, whole: DataFrame, column: str) -> DataFrame:
    """Of the distinct values of ``part`` (or of ``whole``): the share that is in both.
    One row: n_part, n_whole, n_both, activation (both / whole), conformance (both / part)."""
    p, w = part.select(column).distinct().withColumn("p", F.lit(1)), whole.select(column).distinct().withColumn("w", F.lit(1))
    j = p.join(w, column, "full_outer")
    n = j.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_part"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_whole"), F.count_if(F.col("p").isNotNull() & F.col("w").isNotNull()).alias("n_both"))
    return n.select("*", (F.col("n_both") / F.nullif("n_whole", F.lit(0))).alias("activation"), (F.col("n_both") / F.nullif("n_part", F.lit(0))).alias("conformance"))


def missing_types(declared: DataFrame, there: DataFrame, column: str) -> DataFrame:
    return declared.select(column).distinct().join(there.select(column).distinct(), column, "left_anti")


# Tier 1

def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


def _keys(df: DataFrame, name: str, mark: str) -> DataFrame:
    """Distinct stripped, non-blank values of a one-column table, with a mark."""
    return df.select(strip(F.col(df.columns[0]).cast("string")).alias(name)).where(F.col(name) != "").distinct().withColumn(mark, F.lit(True))


def resolution_rate(rows: DataFrame, start: str, end: str, starts: DataFrame, ends: DataFrame, filter_column: str | None = None, filter_value: str | None = None) -> DataFrame:
    """One row: rows (after the filter, compared as text), those whose both ends are
    among the known values (single-column tables), and the rate. Values are
    compared stripped; a row with a blank end counts as one that does not resolve.
    Without rows the rate is null."""
    if filter_column and filter_value is not None and filter_column in rows.columns:
        rows = rows.where(F.col(filter_column).cast("string") == str(filter_value))
    r = rows.select(strip(F.col(start).cast("string")).alias("s"), strip(F.col(end).cast("string")).alias("e"))
    j = r.join(_keys(starts, "s", "a"), "s", "left").join(_keys(ends, "e", "b"), "e", "left")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_resolved"), rate(ok).alias("resolution_rate"))


def match_rate(source: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """(n_eligible, match_rate): a source's non-blank merge keys, and the share of them that
    is known, both compared stripped; null if the source lacks the column or has no key."""
    if column not in source.columns:
        return source.sparkSession.createDataFrame([(0, None)], "n_eligible long, match_rate double")
    s = source.select(strip(F.col(column).cast("string")).alias("k")).where("k <> ''")
    return s.join(_keys(known, "k", "m"), "k", "left").agg(F.count(F.lit(1)).alias("n_eligible"), rate(F.col("m").isNotNull()).alias("match_rate"))


# Tier 2

def orphan_rate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node type: node rows, those on no edge (rows without an id are not counted
    among them), and their rate."""
    d = algo.degrees(edges).select(F.col("node").alias("id"), F.lit(True).alias("on_edge"))
    alone = F.col("on_edge").isNull() & F.col("id").isNotNull()
    return nodes.join(d, "id", "left").groupBy("node_type").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(alone).alias("n_orphans"), rate(alone).alias("orphan_rate"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows beyond the first per key (null keys equal), their rate."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return g.agg(n.alias("n_rows"), (n - F.count(F.lit(1))).alias("n_duplicates"), F.coalesce((n - F.count(F.lit(1))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("duplicate_rate"))


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """One row: nodes beyond the first with their id, within a node type; null ids do not count."""
    g = nodes.where("id is not null").groupBy("node_type", "id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_repeated"))


def references(nodes: DataFrame, columns: Sequence[str], node_id: str = "id") -> DataFrame:
    """(value, id): every stripped, non-blank value of the reference columns and the nodes
    that hold it; whichever column holds a value, it is the same value."""
    values = F.array(*[strip(F.col(c).cast("string")) for c in columns])
    return nodes.select(F.col(node_id).alias("id"), F.explode(values).alias("value")).where("value <> '' and id is not null").select("value", "id").distinct()


def _holders(refs: DataFrame) -> DataFrame:
    return refs.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def reference_resolution(refs: DataFrame) -> DataFrame:
    """One row over ``references``: entries, those whose value another node holds too, and
    their rate (null without entries)."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    g = _holders(refs).agg(n("n").alias("n_entries"), n(F.when(F.col("n") > 1, F.col("n"))).alias("n_resolved"))
    return g.withColumn("resolution_rate", F.col("n_resolved") / F.nullif("n_entries", F.lit(0)))


def shared_reference_pairs(refs: DataFrame) -> DataFrame:
    """One row over ``references``: values held by several nodes, and the pairs of nodes
    they make, n(n-1)/2 each."""
    g = _holders(refs).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_values"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("n_pairs"))


def nodes_per_value(refs: DataFrame) -> DataFrame:
    """(value, ids): which nodes, of whatever type, hold a value; sorted."""
    return refs.groupBy("value").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def degree_outliers(edges: DataFrame, q: float = 0.99, group: str = "rel_type") -> DataFrame:
    """Per relation: the exact interpolated quantile of the degrees its nodes have in it, and
    how many lie above. Degrees are counted into a histogram first, so a relation is
    as many rows as it has distinct degrees."""
    h = algo.degrees(edges, by=(group,)).groupBy(group, "degree").agg(F.count(F.lit(1)).alias("n"))
    p = h.groupBy(group).agg(F.expr(f"percentile(degree, {q}, n)").alias("p99"))
    return h.join(p, group).groupBy(group, "p99").agg(F.coalesce(F.sum(F.when(F.col("degree") > F.col("p99"), F.col("n"))), F.lit(0)).alias("n_above"))


def count_deltas(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, n, n_before, delta) of what there is now; what was not there before counts 0.
    A null key is a key like any other."""
    a, b = now.alias("a"), before.alias("b")
    old = F.coalesce("b.n", F.lit(0))
    return a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "left").select(F.col(f"a.{key}").alias(key), F.col("a.n").alias("n"), old.alias("n_before"), (F.col("a.n") - old).alias("delta"))


def largest_delta(deltas: DataFrame) -> DataFrame:
    """One row over ``count_deltas``: how many keys changed, and the largest change either way (0 without keys)."""
    return deltas.agg(F.count_if(F.col("delta") != 0).alias("n_changed"), F.coalesce(F.max(F.abs("delta")), F.lit(0)).cast("long").alias("max_abs_delta"))


def property_completeness(expected: dict[str, Sequence[str]], found: dict[str, Sequence[str]]) -> list[tuple[str, list[str], float]]:
    """(type, missing properties, completeness) for every expected type."""
    return [(t, sorted(set(ps) - set(found.get(t, []))), len(set(ps) & set(found.get(t, []))) / len(set(ps)) if ps else 1.0) for t, ps in expected.items()]


# Tier 3: against outside references

def known_pairs(lines: DataFrame, gene: str = "gene", phenotypes: str = "phenotypes") -> DataFrame:
    """(gene, disease) of catalog lines whose phenotype text names a disease number with
    a confirmed mapping, `123456 (3)`."""
    ids = F.regexp_extract_all(phenotypes, F.lit(r"(\d{6})\s*\(3\)"), F.lit(1))
    return lines.where(~is_blank(gene)).select(F.col(gene).alias("gene"), F.explode(ids).alias("disease")).distinct()


def recall(known: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the known rows (all columns) that are found."""
    k = known.distinct()
    f = found.select(*known.columns).distinct().withColumn("f", F.lit(True))
    return k.join(f, list(known.columns), "left").agg(F.count(F.lit(1)).alias("n_known"), F.count_if(F.col("f").isNotNull()).alias("n_found"), rate(F.col("f").isNotNull()).alias("recall"))


def coverage(of: DataFrame, by: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``of`` that are also in ``by``."""
    a, b = of.select(column).where(~is_blank(column)).distinct(), by.select(column).distinct().withColumn("b", F.lit(True))
    return a.join(b, column, "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b").isNotNull()).alias("n_covered"), rate(F.col("b").isNotNull()).alias("coverage"))
