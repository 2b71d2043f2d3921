"""Co-occurrence of two kinds of entities in documents, with the one-sided Fisher test.

Pairs come from an equi-join on the document, never from a nested loop over
entities; only pairs that meet are made. The entities of a large document are
cut into blocks whose pairs are keys of their own, so no task makes them all. The tail of the hypergeometric
distribution is summed in log space by built-in expressions: log-factorials
from a Stirling series (exact values below 10), so no table is built and no
Python runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: ln 0! to ln 9!, then Stirling's series:
#: n ln n - n + ln(2 pi n)/2 + 1/(12n) - 1/(360n^3) + 1/(1260n^5) - 1/(1680n^7), error below 1e-12.
_SMALL = "array(" + ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(10)) + ")"
LOG_FACTORIAL = f"if(n < 10, {_SMALL}[cast(greatest(n, 0) as int)], n * ln(n) - n + ln({2 * math.pi!r}D * n) / 2 + 1 / (12D * n) - 1 / (360D * pow(n, 3)) + 1 / (1260D * pow(n, 5)) - 1 / (1680D * pow(n, 7)))"


def with_fisher(df: DataFrame, a: str, n_s: str, n_t: str, total: str, name: str = "p_fisher") -> DataFrame:
    """df with P(X >= a) for X hypergeometric: total documents, n_s of one kind, n_t drawn.

    One term comes from log-factorials, the others by the ratio of neighbours.
    The sum runs away from the mode, where terms only fall: upwards from a above
    it, else downwards from a - 1 for the complement. A first term too small for
    a double is then truly nothing. Terms below 2^-60 of the first add nothing, and
    by Bernstein's inequality none is larger beyond 40 + 11 standard deviations
    (of the binomial, which is the wider), so the sum stops there.
    """
    keep = df.columns
    x = df.selectExpr("*", f"cast({a} as bigint) as _a", f"cast({n_s} as bigint) as _s", f"cast({n_t} as bigint) as _t", f"cast({total} as bigint) as _n")
    x = x.selectExpr("*", "_a > floor((_s + 1) * (_t + 1) / (_n + 2D)) as _up", "greatest(_s + _t - _n, 0L) as _low", "ceil(40D + 11D * sqrt(_t * (_s / cast(_n as double)) * (1 - _s / cast(_n as double)))) as _reach")
    x = x.selectExpr("*", "if(_up, _a, _a - 1) as _k0")
    # Each stage is a projection of its own: an expression used several times is made once.
    x = x.selectExpr("*", f"transform(array(_s, _k0, _s - _k0, _n - _s, _t - _k0, _n - _s - _t + _k0, _n, _t, _n - _t), n -> {LOG_FACTORIAL}) as _l")
    x = x.selectExpr("*", "exp(_l[0] - _l[1] - _l[2] + _l[3] - _l[4] - _l[5] - _l[6] + _l[7] + _l[8]) as _p0")
    step = "named_struct('p', if(z.p > _p0 * pow(2D, -60), z.p * ({ratio}), 0D), 's', z.s + if(z.p > _p0 * pow(2D, -60), z.p * ({ratio}), 0D))"
    up = step.format(ratio="(_s - k + 1) * cast(_t - k + 1 as double) / (k * (_n - _s - _t + k))")
    down = step.format(ratio="(k + 1) * cast(_n - _s - _t + k + 1 as double) / ((_s - k) * (_t - k))")
    ks_up = "if(_a < least(_s, _t), sequence(_a + 1, least(_s, _t, _a + _reach)), cast(array() as array<bigint>))"
    ks_down = "if(_k0 > _low, sequence(_k0 - 1, greatest(_low, _k0 - _reach), -1L), cast(array() as array<bigint>))"
    first = "named_struct('p', _p0, 's', _p0)"
    p = f"case when _up then aggregate({ks_up}, {first}, (z, k) -> {up}).s when _k0 < _low then 1D else 1D - aggregate({ks_down}, {first}, (z, k) -> {down}).s end"
    return x.selectExpr(*[f"`{c}`" for c in keep], f"least(greatest({p}, 0D), 1D) as `{name}`")


def meeting(source: DataFrame, target: DataFrame, block: int = 256) -> DataFrame:
    """(source_id, target_id, doc) of distinct ``source(source_id, doc)`` and
    ``target(target_id, doc)``. A document with more than ``block`` sources is met
    block by block: each source is in one block, each target comes to all."""
    large = source.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block).select("doc", F.ceil(F.col("k") / F.lit(block)).cast("int").alias("g"))
    s = source.join(large, "doc", "left").select("source_id", "doc", F.coalesce(F.pmod(F.xxhash64("source_id"), F.col("g")), F.lit(0)).cast("int").alias("b"))
    t = target.join(large, "doc", "left").select("target_id", "doc", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("g") - 1, F.lit(0)))).alias("b"))
    return s.join(t, ["doc", "b"]).select("source_id", "target_id", "doc")


def pair_statistics(source: DataFrame, target: DataFrame, corpus: int, upper_triangle: bool = False, block: int = 256) -> DataFrame:
    """``source(source_id, doc)``, ``target(target_id, doc)`` -> per pair that meets:
    cooccurrence, enrichment, p_fisher, odds_ratio.

    With a = documents of both, b and c of one only, d = max(corpus - a - b - c, 0):
    enrichment = a / (n_s n_t / corpus), odds_ratio = a d / (b c), infinite where b c = 0.
    ``upper_triangle`` keeps source_id < target_id. Repeated rows count once,
    nulls are ignored, empty inputs give an empty result.
    """
    s = source.where("source_id is not null and doc is not null").select("source_id", "doc").distinct()
    t = target.where("target_id is not null and doc is not null").select("target_id", "doc").distinct()
    j = meeting(s, t, block)
    if upper_triangle:
        j = j.where("source_id < target_id")
    pairs = j.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("cooccurrence"))
    ns = s.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_s"))
    nt = t.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_t"))
    x = pairs.join(ns, "source_id").join(nt, "target_id")
    a = F.col("cooccurrence")
    b, c = F.col("n_s") - a, F.col("n_t") - a
    d = F.greatest(F.lit(corpus) - a - b - c, F.lit(0))
    x = x.withColumn("_total", a + b + c + d)
    enrichment = F.when(F.lit(corpus) > 0, a * F.lit(float(corpus)) / (F.col("n_s") * F.col("n_t"))).otherwise(F.lit(float("inf")))
    odds = F.when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / (b * c))
    x = x.select("source_id", "target_id", "cooccurrence", "n_s", "n_t", "_total", F.round(enrichment, 4).alias("enrichment"), F.round(odds, 6).alias("odds_ratio"))
    return with_fisher(x, "cooccurrence", "n_s", "n_t", "_total").select("source_id", "target_id", "cooccurrence", "enrichment", "p_fisher", "odds_ratio")


def corpus_size(source: DataFrame, target: DataFrame) -> int:
    """Documents that occur on both sides."""
    return source.select("doc").distinct().join(target.select("doc").distinct(), "doc", "left_semi").count()
