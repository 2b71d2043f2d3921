"""Choosing rows: first per key in a stated order, upserts, anti and semi reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key in the stated order; null keys are one group.

    As an aggregate (min_by over the row) rather than a window: rows are reduced
    before the shuffle, so a key that holds a third of all rows is one row per
    task. ``order`` must tell the rows of a key apart for a stable choice; nulls
    come first.
    """
    o = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), o).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    o = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), o).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def with_ordinal(df: DataFrame, name: str = "_ord") -> DataFrame:
    """The order of rows in their files: file name, then position within it."""
    return df.withColumn(name, F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def merge_upsert(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All rows of ``base``, enriched by ``other`` where the key matches, and the rows
    of ``other`` that match nothing. Base values win where both are set. Null and
    blank keys never match, so such rows of ``other`` are inserted."""
    k = F.nullif(F.col(key).cast("string"), F.lit(""))
    a, b = base.withColumn("_k", k), other.withColumn("_k", k)
    cols = list(dict.fromkeys([*base.columns, *other.columns]))
    a = a.select("_k", *[F.col(c).alias(f"a_{c}") for c in base.columns])
    b = b.select("_k", *[F.col(c).alias(f"b_{c}") for c in other.columns])
    pick = lambda c: F.coalesce(*[F.col(f"{s}_{c}") for s, d in (("a", base), ("b", other)) if c in d.columns]).alias(c)
    return a.join(b, "_k", "full_outer").select(*map(pick, cols))


def override_union(base: DataFrame, winner: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Union by key in which rows of ``winner`` replace those of ``base``."""
    u = winner.withColumn("_rank", F.lit(0)).unionByName(base.withColumn("_rank", F.lit(1)))
    return keep_first(u, [key], ["_rank", *order]).drop("_rank")


def bag_append(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns matched by name, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ensure_columns(df: DataFrame, columns: dict[str, str], default: object = None) -> DataFrame:
    """Columns that are missing are added with the default; order as given, others after."""
    for c, t in columns.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(default).cast(t))
    return df.select(*columns, *[c for c in df.columns if c not in columns])


def first_and_last(df: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """The first row of each group and its last ``keep`` - 1 rows (all, if there are no more)."""
    w, back = Window.partitionBy(group).orderBy(order), Window.partitionBy(group).orderBy(F.desc(order))
    return df.withColumn("_a", F.row_number().over(w)).withColumn("_b", F.row_number().over(back)).where((F.col("_a") == 1) | (F.col("_b") <= keep - 1)).drop("_a", "_b")


def unmatched(df: DataFrame, dimension: DataFrame, on: str, key: str, show: int | None = None) -> DataFrame:
    """The distinct values that the dimension lacks, sorted; for a report the first ``show``."""
    x = df.select(F.col(on).alias("value")).where("value is not null").distinct().join(dimension.select(F.col(key).alias("value")).distinct(), "value", "left_anti").orderBy("value")
    return x.limit(show) if show is not None else x


def lookup(df: DataFrame, dimension: DataFrame, on: str, key: str, value: str, name: str, default: object = None) -> DataFrame:
    """A left join to a dimension with one row per key (the first by value if there
    are more); unmatched rows get the default. The dimension is broadcast by the
    optimizer if its statistics are below the threshold, else both sides are shuffled."""
    dim = dimension.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(value).alias(name))
    out = df.join(dim, df[on] == dim["_key"], "left").drop("_key")
    return out if default is None else out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def resolve_two(df: DataFrame, dimension: DataFrame, left: str, right: str, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Both ends looked up in one dimension; rows with an unmatched end are dropped."""
    x = lookup(df, dimension, left, key, value, names[0])
    x = lookup(x, dimension, right, key, value, names[1])
    return x.na.drop(subset=list(names))
