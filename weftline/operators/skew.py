"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

Stage 1 adds a salt to the keys that are heavy and aggregates by (key, salt);
stage 2 merges the partial results by key. Keys that are not heavy get salt 0
and go through both stages unchanged. The salt is a hash of a row's identity,
not a random number, so a task that is run again after an executor was lost
sends every row where it went before.

Which keys are heavy is estimated from a hash sample of the rows; that decides
only how the work is spread, never a result. A key with a share of at least
``heavy_share`` of the sample is heavy, so there are at most 1/heavy_share
heavy keys per group of keys: a proven bound on what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.storage import Scratch

SAMPLE_MOD = 16


def heavy_keys(df: DataFrame, keys: Sequence[str], identity: Column, heavy_share: float = 0.005, per_salt: float = 0.002) -> DataFrame:
    """(keys..., salts): keys with at least ``heavy_share`` of the sampled rows and
    over how many salts each is spread, so that one salt holds about ``per_salt``
    of all rows. At most 1/heavy_share rows; made on the driver. One scan."""
    sample = df.where(F.pmod(F.xxhash64(identity, F.lit(77)), F.lit(SAMPLE_MOD)) == 0)
    n = Scratch(sample.groupBy(*keys).count(), "sampled-keys")
    total = n.df.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    rows = n.df.where(F.col("count") >= max(2.0, heavy_share * total)).withColumn("salts", F.ceil(F.col("count") / F.lit(max(1.0, per_salt * total))).cast("int")).select(*keys, "salts").collect()
    spark = df.sparkSession
    schema = n.df.select(*keys).withColumn("salts", F.lit(0)).schema
    n.drop()
    return spark.createDataFrame(rows, schema)


def with_salt(df: DataFrame, keys: Sequence[str], identity: Column, heavy: DataFrame) -> DataFrame:
    """df with a column ``__salt``: 0 for ordinary keys, a stable spread over
    0..salts-1 for heavy ones. A null key is a key like any other."""
    h = F.broadcast(heavy.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("salts").alias("__salts")))  # at most 1/heavy_share rows
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    salt = F.coalesce(F.pmod(F.xxhash64(identity), F.col("__salts")), F.lit(0)).cast("int")
    return df.join(h, same, "left").withColumn("__salt", salt).drop("__salts", *[f"__{i}" for i in range(len(keys))])


@dataclass(frozen=True)
class Measure:
    """One result column: ``part`` makes the partial result from rows, ``merge``
    makes the result from the column of partial results."""

    name: str
    part: Column
    merge: Callable[[str], Column]


def count_rows(name: str) -> Measure:
    return Measure(name, F.count(F.lit(1)), F.sum)


def sum_of(name: str, c: str) -> Measure:
    return Measure(name, F.sum(c), F.sum)


def min_of(name: str, c: str) -> Measure:
    return Measure(name, F.min(c), F.min)


def max_of(name: str, c: str) -> Measure:
    return Measure(name, F.max(c), F.max)


def salted_aggregate(df: DataFrame, keys: Sequence[str], identity: Column, measures: Sequence[Measure], within: Sequence[str] = (), heavy_share: float = 0.005) -> DataFrame:
    """Results per ``keys + within``, heavy values of ``keys`` spread over salts.

    Rows with null keys form a group of their own, as in GROUP BY. ``identity``
    should differ between the rows of a key (a row id); where it does not, the
    result stays right and only the spread suffers. An empty table gives an
    empty result. Other columns of df are ignored.
    """
    salted = with_salt(df, keys, identity, heavy_keys(df, keys, identity, heavy_share))
    part = salted.groupBy(*keys, *within, "__salt").agg(*[m.part.alias(m.name) for m in measures])
    # Partitioned by the keys alone, so that results per key can follow without another exchange.
    return part.repartition(*keys).groupBy(*keys, *within).agg(*[m.merge(m.name).alias(m.name) for m in measures])
