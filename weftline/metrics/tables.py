"""Quality of extracted tables: each metric a column of one aggregate per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import IDENTIFIER_PATTERNS, NUMERIC, is_blank, strip


def rate(p: Column) -> Column:
    """Share of rows for which the predicate holds; unknown is no."""
    return F.avg(F.coalesce(p, F.lit(False)).cast("double"))


def direct_download(notes: str) -> Column:
    return ~F.coalesce(F.lower(F.col(notes)).contains("github"), F.lit(False))


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, extracted): extracted means there is a row."""
    out = None
    for name, df in tables.items():
        r = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")).withColumn("extracted", F.col("n_rows") > 0)
        out = r if out is None else out.unionByName(r)
    return out


def filter_pass_rate(df: DataFrame, column: str, value: str) -> DataFrame:
    """Share of rows whose column equals the value, compared as text."""
    return df.agg(rate(F.col(column).cast("string") == value).alias("pass_rate"))


def duplication(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key, repeats among them, and their share; keys are stripped, blank ones left out."""
    k = df.select(strip(F.col(key).cast("string")).alias("k")).where("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return k.agg(n.alias("n_keys"), (n - F.count(F.lit(1))).alias("n_duplicates"), F.coalesce((n - F.count(F.lit(1))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("duplication_rate"))


def _stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_rate) for all columns in one scan; blank counts as null."""
    return _stacked(df, columns).groupBy("column_name").agg(rate(is_blank("value")).alias("null_rate"))


def identifier_validity(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column_name, n_values, validity_rate): non-blank values of a column that match its kind."""
    v = _stacked(df, list(kinds)).where(~is_blank("value"))
    ok = F.lit(False)
    for c, k in kinds.items():
        ok = ok | ((F.col("column_name") == c) & strip("value").rlike(f"^(?:{IDENTIFIER_PATTERNS[k]})$"))
    return v.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_values"), rate(ok).alias("validity_rate"))


def numeric_violations(df: DataFrame, columns: Sequence[str], least: float = 0.9) -> DataFrame:
    """(column_name, n_values, n_violations) of columns of which more than ``least`` of the
    non-blank values are numbers: the rest of the values, all columns in one scan."""
    v = _stacked(df, columns).where(~is_blank("value"))
    g = v.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_values"), F.count_if(~strip("value").rlike(NUMERIC)).alias("n_violations"))
    return g.where((F.col("n_values") - F.col("n_violations")) > least * F.col("n_values"))


def schema_conformance(declared: dict[str, Sequence[str]], tables: dict[str, DataFrame]) -> list[tuple[str, list[str], list[str]]]:
    """(table, missing, additional columns) where they differ; a missing table lacks all."""
    out = []
    for t, cols in declared.items():
        have = tables[t].columns if t in tables else []
        missing, more = sorted(set(cols) - set(have)), sorted(set(have) - set(cols))
        if missing or more:
            out.append((t, missing, more))
    return out


def extraction_dates(df: DataFrame) -> DataFrame:
    """The latest day (UTC) on which a file of the table was written."""
    return df.select(F.col("_metadata.file_modification_time").alias("t")).agg(F.date_format(F.max("t"), "yyyy-MM-dd").alias("extracted_on"))
