"""Mixing sources to target shares of the total size in tokens.

Tokens are summed per source; a source's rate is how many times each of its
documents must be used to fill its share, at most its cap. A document comes
out floor(rate) times, and once more with probability equal to the fraction,
decided by a hash of its id and the seed: the same on every run and machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import strip


def clean_source(c: str):
    return F.lower(strip(c))


def source_rates(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """Per listed source: (source, target_share, max_repeats, size, total, wanted_rate, rate, short).

    ``sizes(source, n_tokens)`` per document, ``weights(source, target_share,
    max_repeats)``. total is the size of all documents, listed sources or not;
    short marks sources that even at their cap stay below their share. A listed
    source without any document has size 0 and is short if its share is above 0.
    """
    by = sizes.groupBy(clean_source("source").alias("source")).agg(F.sum("n_tokens").alias("size"))
    total = by.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    w = weights.select(clean_source("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    # A source listed twice counts with its largest share.
    w = w.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("w")).select("source", "w.target_share", "w.max_repeats")
    x = w.join(by, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    x = x.withColumn("total", F.lit(total).cast("long"))
    wanted = F.col("target_share") * F.col("total")
    rate = F.when(F.col("size") > 0, wanted / F.col("size")).otherwise(F.lit(0.0))
    return x.select("source", "target_share", "max_repeats", "size", "total", rate.alias("wanted_rate"), F.least(rate, F.col("max_repeats").cast("double")).alias("rate"), (F.col("size") * F.col("max_repeats") < wanted).alias("short"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 13, key: str = "doc_id") -> DataFrame:
    """``docs(key, source, n_tokens)`` -> (key, source, copy_no, n_tokens), copies
    numbered from 1. Documents of unlisted or null sources are not used."""
    listed = F.broadcast(rates.select("source", "rate"))  # one row per listed source, a configured few
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
    whole = F.floor("rate").cast("int")
    n = whole + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    x = docs.select(key, clean_source("source").alias("source"), "n_tokens").join(listed, "source").withColumn("copies", n).where("copies > 0")
    return x.select(key, "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def share_report(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """Per listed source: what it should fill and what it does, in tokens and shares
    of the size of the mixture and of all documents."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.max("copy_no").alias("most_copies"))
    x = rates.join(got, "source", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("most_copies", F.coalesce("most_copies", F.lit(0)))
    mixed = mixed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return x.withColumn("mixed_total", F.lit(mixed)).select("source", "target_share", "size", "rate", "used", "most_copies", "short", F.when(F.col("mixed_total") > 0, F.col("used") / F.col("mixed_total")).alias("share_of_mixture"), F.when(F.col("total") > 0, F.col("used") / F.col("total")).alias("share_of_all"))
