"""References to records that do not exist, at the time of the reference.

Keys are hashed to 64 bits and the hash space is cut into equal ranges, so the
ranges are balanced without sampling and a key's range needs no lookup. The
parents of a range are stored as arrays sorted by key hash, key and start of
life; lives of one key are merged so that they are disjoint. The references of
a range come in batches of bounded size (a key that a third of all rows refer
to fills many batches, each with its own copy of the range's arrays, small beside
it) and every batch is probed at once: a binary search for the key, then one for
the time. Batches are numbered so that a task holds exactly one.
Hash hits are confirmed by comparing the keys themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import is_blank, micros
from weftline.storage import Scratch

FOREVER = np.iinfo(np.int64).max


def range_of(key: Column, ranges: int) -> Column:
    """Equal ranges of the signed 64-bit hash, in the order of the hash."""
    top = F.shiftright(F.xxhash64(key), 32)  # -2^31 .. 2^31-1
    return F.floor((top + F.lit(2**31)) * F.lit(ranges) / F.lit(2**32)).cast("int")


def parent_ranges(parents: DataFrame, ranges: int) -> DataFrame:
    """(rng, entries): per range the sorted array of (h, key, born, died), times in
    microseconds, died open-ended where null. Rows with a null key or birth are
    no parents. Births that repeat are reduced before the shuffle to the life
    that lasts longest."""
    p = parents.where("key is not null and born is not null").select("key", micros("born").alias("born"), F.coalesce(micros("died"), F.lit(int(FOREVER))).alias("died"))
    p = p.groupBy("key", "born").agg(F.max("died").alias("died"))
    return p.select(range_of(F.col("key"), ranges).alias("rng"), F.struct(F.xxhash64("key").alias("h"), "key", "born", "died").alias("e")).groupBy("rng").agg(F.sort_array(F.collect_list("e")).alias("entries"))


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """One batch of references against one range of parents."""
    n = refs.num_rows
    at = refs.column("at").cast(pa.int64()).combine_chunks().to_numpy(zero_copy_only=False)
    kind = np.zeros(n, dtype=np.int8)  # 0 missing, 1 deleted, 2 later, 3 present
    if n and parents.num_rows and len(entries := parents.column("entries").combine_chunks().flatten()):
        h, key, born, died = (entries.field(k) for k in ("h", "key", "born", "died"))
        h, born, died = h.to_numpy(), born.to_numpy(), died.to_numpy()
        # One row per key: where its lives begin and end in the arrays.
        key = key.cast(pa.large_string())
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | ~pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h))
        # Lives are made disjoint: each end is the furthest so far within its key.
        own = np.cumsum(new) - 1
        reach = _running_max(died, own)
        rh = refs.column("h").combine_chunks().to_numpy()
        rk = refs.column("key").combine_chunks().cast(pa.large_string())
        heads, keys = h[first], key.take(pa.array(first))
        pos = np.searchsorted(heads, rh, side="left")
        found = np.full(n, -1)
        todo = np.arange(n)
        while len(todo):  # more than one turn only where hashes of different keys collide
            todo = todo[(pos[todo] < len(heads))]
            todo = todo[heads[pos[todo]] == rh[todo]]
            if not len(todo):
                break
            same = pc.equal(keys.take(pa.array(pos[todo])), rk.take(pa.array(todo))).to_numpy(zero_copy_only=False)
            found[todo[same]] = pos[todo[same]]
            todo = todo[~same]
            pos[todo] += 1
        hit = np.flatnonzero(found >= 0)
        lo, hi = first[found[hit]], last[found[hit]]
        start, t = lo.copy(), at[hit]
        while (open_ := lo < hi).any():  # the last life that began at or before t
            mid = (lo + hi) // 2
            right = open_ & (born[np.minimum(mid, len(born) - 1)] <= t)
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        begun = lo > start
        alive = begun & (reach[np.maximum(lo - 1, 0)] > t)
        kind[hit] = np.where(alive, 3, np.where(begun, 1, 2))
    keep = np.flatnonzero(kind != 3)
    out = refs.select(["ref_id", "side"]).take(pa.array(keep))
    return out.append_column("kind", pa.array(np.array(["missing", "deleted", "later"], dtype=object)[kind[keep]], pa.string())).append_column("at", refs.column("at").take(pa.array(keep)))


def _running_max(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running maximum within consecutive groups, in a few whole-array steps."""
    out, step, n = x.copy(), 1, len(x)
    longest = int(np.bincount(group).max()) if n else 0
    while step < longest:
        same = group[step:] == group[:-step]
        shifted = np.where(same, out[:-step], np.iinfo(np.int64).min)
        out[step:] = np.maximum(out[step:], shifted)
        step *= 2
    return out


def _numbers_by_partition(spark: SparkSession, tasks: int, each: int) -> list[int]:
    """tasks * each distinct whole numbers in the order 0, 1, .. of the partition to which Spark's
    hash sends them (repeated ``each`` times): with these as keys no two of the first
    ``tasks`` share a partition."""
    seen: list[list[int]] = [[] for _ in range(tasks)]
    n, start, short = max(1000, 16 * tasks * each), 0, tasks
    while short:
        for r in spark.range(start, start + n).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).toLocalIterator():
            if len(seen[r.p]) < each:
                seen[r.p].append(r.id)
                short -= len(seen[r.p]) == each
        start += n
    return [x for k in range(each) for x in (s[k] for s in seen)]


def orphans(refs: DataFrame, parents: DataFrame, per_range: int = 1 << 14, per_batch: int = 150_000, max_tasks: int = 1 << 15) -> DataFrame:
    """(ref_id, side, kind, at) of references without a parent alive at that time.

    ``refs(ref_id, side, key, at)``, ``parents(key, born, died)``. A reference
    counts unless its key is null or blank; keys are compared exactly as written.
    kind is missing (no parent row has the key), deleted (one was born by then,
    none is alive) or later (all were born afterwards). A reference without a
    time (null) has no parent at that time: missing, or later if the key exists.
    Repeated rows are reported each; empty tables give an empty result (without
    parents every reference is missing). Ranges hold about ``per_range`` parents
    and batches about ``per_batch`` references at any size; beyond ``max_tasks``
    batches a task takes several, one after the other.
    """
    spark = refs.sparkSession
    ranges = max(1, -(-parents.count() // per_range))
    store = Scratch(parent_ranges(parents, ranges), "parents").df
    r = refs.where(~is_blank("key")).select("ref_id", "side", "key", F.coalesce(micros("at"), F.lit(int(np.iinfo(np.int64).min))).alias("at"), range_of(F.col("key"), ranges).alias("rng"))
    # Batches per range from its count of references: one row per range.
    batches = sorted((x.rng, -(-x["count"] // per_batch)) for x in r.groupBy("rng").count().collect())
    n = sum(b for _, b in batches)
    tasks = min(max(1, n), max_tasks)
    number = iter(_numbers_by_partition(spark, tasks, -(-max(1, n) // tasks)))
    sizes = spark.createDataFrame([(k, b, [next(number) for _ in range(b)]) for k, b in batches] or [(0, 1, [next(number)])], "rng int, batches int, numbers array<bigint>")
    small = F.broadcast(sizes)  # two ints a range and one number a batch: a millionth of the references and parents
    batch = F.pmod(F.xxhash64("ref_id", "side"), F.col("batches")).cast("int")
    r = r.join(small, "rng").select("ref_id", "side", "key", "at", F.xxhash64("key").alias("h"), F.get("numbers", batch).alias("no"))
    p = store.join(small, "rng").select("entries", F.explode("numbers").alias("no"))
    r, p = r.repartition(tasks, "no"), p.repartition(tasks, "no")
    kind = refs.schema["ref_id"].dataType.simpleString()
    return r.groupBy("no").cogroup(p.groupBy("no")).applyInArrow(_probe, f"ref_id {kind}, side string, kind string, at long")
