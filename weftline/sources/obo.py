"""Ontology files in OBO format, read stanza by stanza with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tag(name: str) -> Column:
    """All values of a tag in a stanza, in order."""
    return F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(name + ": "))), lambda x: F.trim(F.substring(x, F.lit(len(name) + 3), F.length(x))))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """One row per [Term]: id, name, def, namespace, is_obsolete, and the arrays subset,
    xref, synonym, is_a, relationship. Single tags are null where absent, arrays
    empty. Files are split where a line begins with a bracket, so stanzas are read in
    parallel, whatever their line ends and whether or not blank lines part them.

    xref values end before a quoted description or a modifier ({...}).
    """
    s = spark.read.option("lineSep", "\n[").text(path)
    lines = F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x))
    s = s.select(lines.alias("lines")).where("lines[0] in ('Term]', '[Term]')")
    one = lambda t: F.try_element_at(_tag(t), F.lit(1))
    return s.select(
        one("id").alias("id"), one("name").alias("name"), one("def").alias("def"), one("namespace").alias("namespace"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"),
        F.transform(_tag("subset"), lambda x: F.substring_index(x, " ", 1)).alias("subset"), F.transform(_tag("xref"), lambda x: F.regexp_replace(x, r"\s*(?:\".*|\{.*|!.*)$", "")).alias("xref"),
        _tag("synonym").alias("synonym"), _tag("is_a").alias("is_a"), _tag("relationship").alias("relationship"),
    ).where("id is not null")


def xref_pairs(obo: DataFrame, prefix: str) -> DataFrame:
    """(id, xref): one row per cross reference with this prefix, without it."""
    return obo.select("id", F.explode(F.filter("xref", lambda x: F.startswith(x, F.lit(prefix)))).alias("xref")).select("id", F.substring("xref", F.lit(len(prefix) + 1), F.length("xref")).alias("xref"))
