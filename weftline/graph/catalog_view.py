"""The catalog of sources as it is shown: records from its table, facets, what is visible."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import strip

#: The facets that are counted, anything else is obsolete.
STATUSES = ("Implemented", "To-do", "TBD")


def records(rows: DataFrame, node_ids: dict[str, str], edge_ids: dict[str, str]) -> DataFrame:
    """(id, label, integration, active, status, version, parent, nodes, edges) of the rows of
    the catalog table. Rows without an id are left out; labels of types that are not
    known fall away; status and version default to N/A, an empty parent is null."""
    # The headings of the catalog table.
    text = lambda c: F.coalesce(strip(c), F.lit("")) if c in rows.columns else F.lit("")
    or_na = lambda c: F.when(text(c) != "", text(c)).otherwise("N/A")

    def ids(c: str, known: dict[str, str]) -> Column:
        if not known:
            return F.array().cast("array<string>")
        m = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        return F.filter(F.transform(F.split(text(c), ","), lambda x: m[strip(x)]), lambda x: x.isNotNull())

    out = rows.select(
        text("ID").alias("id"), text("Label").alias("label"), text("Integration Path").alias("integration"), (text("Active") == "Yes").alias("active"), or_na("Status").alias("status"), or_na("Latest Version").alias("version"),
        F.nullif(text("Sub-source Of"), F.lit("")).alias("parent"), ids("Biomedical Entities (Node types)", node_ids).alias("nodes"), ids("Biomedical Relationships (Edge types)", edge_ids).alias("edges"))
    return out.where("id <> ''")


def facet_counts(catalog: DataFrame, integrations: Sequence[str]) -> DataFrame:
    """One row: records per way of integration, active and not, per status."""
    one = lambda test, name: F.count_if(test).alias(name)
    return catalog.agg(
        *[one(F.col("integration") == i, i) for i in integrations], one(F.col("active"), "active_yes"), one(~F.col("active"), "active_no"),
        *[one(F.col("status") == s, f"status_{s}") for s in STATUSES], one(~F.col("status").isin(*STATUSES), "status_obsolete"))


def is_visible(integrations: Collection[str], active: Collection[bool] = (True, False), hidden_statuses: Collection[str] = ()) -> Column:
    """Whether a record passes all facets; a status that has no switch is shown."""
    among = lambda c, xs: F.col(c).isin(*xs) if xs else F.lit(False)
    return among("integration", integrations) & among("active", active) & ~among("status", hidden_statuses)


def visible_links(links: DataFrame, catalog: DataFrame, visible: Column) -> DataFrame:
    """``links(source, target)`` neither of whose ends is a hidden record; ends that are no
    records of the catalog (types) hide nothing."""
    hidden = catalog.where(~visible).select("id").distinct()
    return links.join(hidden.withColumnRenamed("id", "source"), "source", "left_anti").join(hidden.withColumnRenamed("id", "target"), "target", "left_anti").select(*links.columns)


def inactive_types(catalog: DataFrame, visible: Column) -> DataFrame:
    """(type): node and edge types to which records contribute, none of them visible and active."""
    x = catalog.select(F.explode(F.array_distinct(F.concat("nodes", "edges"))).alias("type"), (visible & F.col("active")).alias("on"))
    return x.groupBy("type").agg(F.bool_or("on").alias("on")).where("not on").select("type")
