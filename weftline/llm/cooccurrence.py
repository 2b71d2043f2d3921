"""Items that appear together: pair counts per basket and association measures.

Items are made distinct per basket, ordered pairs are emitted and their counts
combined before the shuffle. A basket is never one task's work alone: items of
a large basket are hashed into blocks and every two blocks meet in a task of
their own, so a basket of k items is k^2 / (2 block^2) bounded tasks.

Items that cannot be in any reported pair are left out first, by exact bounds:
n01 <= min(n0, n1), so a pair needs both counts to reach ``min_together``, and
from n01 * n >= lift * n0 * n1 follows n >= lift * max(n0, n1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import cut


def pair_counts(baskets: DataFrame, block: int = 64) -> DataFrame:
    """``baskets(basket, item)``, distinct, without nulls -> (item0, item1, n01) with item0 < item1."""
    sized = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("k"))
    small = sized.where(F.col("k").between(2, block)).select("basket")
    large = sized.where(F.col("k") > block).select("basket", F.ceil(F.col("k") / F.lit(block)).cast("int").alias("g"))
    # Small baskets: one sorted array each, its pairs come out of one expression.
    arrays = baskets.join(small, "basket", "left_semi").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("x"))
    ahead = arrays.select(F.explode(F.transform("x", lambda v, i: F.struct(v.alias("item0"), F.slice("x", i + 2, F.size("x")).alias("rest")))).alias("y")).where("size(y.rest) > 0").select("y.item0", F.explode("y.rest").alias("item1"))
    counts = ahead.groupBy("item0", "item1").agg(F.count(F.lit(1)).alias("n01"))
    # Large baskets: items by block, every two blocks (and each with itself) a task row.
    b = baskets.join(large, "basket").withColumn("b", F.pmod(F.xxhash64("item"), F.col("g")).cast("int"))
    meet = b.select("basket", "item", "b", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")).select("basket", "item", "b", F.least("b", "other").alias("p"), F.greatest("b", "other").alias("q"))
    cell = meet.groupBy("basket", "p", "q").agg(F.collect_list(F.when(F.col("b") == F.col("p"), F.col("item"))).alias("u"), F.collect_list(F.when((F.col("b") == F.col("q")) & (F.col("p") != F.col("q")), F.col("item"))).alias("w"))
    inner = F.filter(F.flatten(F.transform("u", lambda s: F.transform("u", lambda t: F.struct(s.alias("item0"), t.alias("item1"))))), lambda z: z["item0"] < z["item1"])
    across = F.flatten(F.transform("u", lambda s: F.transform("w", lambda t: F.struct(F.least(s, t).alias("item0"), F.greatest(s, t).alias("item1")))))
    more = cell.select(F.explode(F.when(F.col("p") == F.col("q"), inner).otherwise(across)).alias("z")).select("z.*").groupBy("item0", "item1").agg(F.count(F.lit(1)).alias("n01"))
    return counts.unionByName(more).groupBy("item0", "item1").agg(F.sum("n01").alias("n01"))


def associations(occurrences: DataFrame, n_baskets: int, min_together: int = 1, min_lift: float = 0.0, block: int = 64) -> DataFrame:
    """``occurrences(basket, item)`` -> (item0, item1, n0, n1, n01, lift, pmi) of the
    pairs with n01 >= min_together and lift >= min_lift.

    lift is n01 * n / (n0 * n1) with n = ``n_baskets`` (baskets without any item
    count too), pmi its logarithm to base 2. Null baskets and items are ignored,
    repeated rows count once; no occurrences give an empty result.
    """
    occ = cut(occurrences.where("basket is not null and item is not null").select("basket", "item").distinct(), "occurrences")
    counts = cut(occ.groupBy("item").agg(F.count(F.lit(1)).alias("c")), "items")
    usable = counts.where((F.col("c") >= min_together) & (F.col("c") * F.lit(float(min_lift)) <= n_baskets))
    pairs = pair_counts(occ.join(usable.select("item"), "item", "left_semi"), block).where(F.col("n01") >= min_together)
    x = pairs.join(counts.select(F.col("item").alias("item0"), F.col("c").alias("n0")), "item0").join(counts.select(F.col("item").alias("item1"), F.col("c").alias("n1")), "item1")
    # Products of counts leave 64 bits at billions of baskets; as decimals they are exact.
    d = lambda c: c.cast("decimal(19,0)")
    together, chance = d(F.col("n01")) * d(F.lit(n_baskets)), d(F.col("n0")) * d(F.col("n1"))
    exact = together.cast("double") >= F.lit(float(min_lift)) * chance.cast("double")
    lift = together.cast("double") / chance.cast("double")
    return x.where(exact).select("item0", "item1", "n0", "n1", "n01", lift.alias("lift"), F.log2(lift).alias("pmi"))
