"""Column profiles from maintained value-count tables.

A store keeps, per table, column and load, how often each value occurs, in
signed deltas ``(table_name, load_no, sign, column_name, value, n)``. A load is
one delta, and a folder of its own: delivering it again replaces it, withdrawing
it adds the same counts with the sign -1, delivering it after that takes the
withdrawal back. ``sync`` compares the loads of a table with what the store
holds of them and applies a delta for each that is new, changed or gone, and
nothing for the others. Reading sums the deltas and drops what cancels.

All metrics follow from the counts: exact, without a second look at the rows.
Values are compared as text; a null value is kept as null, so that null rates
come from the same table. Counting is combined before the shuffle, so a value
that fills a third of a column is a few rows per task.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.functions.text import is_blank
from weftline.storage import delete, make_folder, matching, read_small, scratch_path, write_small

SCHEMA = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("n", T.LongType()), T.StructField("table_name", T.StringType()), T.StructField("load_no", T.IntegerType()), T.StructField("sign", T.IntegerType())])


def value_counts(df: DataFrame, table_name: str, columns: Sequence[str], load: str | None = "load_no") -> DataFrame:
    """The counts of one table's rows, one scan for all columns. ``load`` None: the
    table has no deliveries, and load_no is null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select((F.col(load) if load else F.lit(None)).cast("int").alias("load_no"), F.explode(pairs).alias("p"))
        .groupBy("p.column_name", "load_no", "p.value").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(table_name).alias("table_name"), "column_name", "load_no", "value", "n")
    )


class ValueCounts:
    """The maintained table, a folder of Parquet deltas by table, load and sign. It lasts as
    long as ``path``; None puts it into the shared scratch folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or scratch_path(spark, "value-counts")).rstrip("/")
        make_folder(spark, self.path)

    def _folder(self, table: str, load: int | None, sign: int) -> str:
        return f"{self.path}/table_name={table}/load_no={'__HIVE_DEFAULT_PARTITION__' if load is None else load}/sign={sign}"

    def _write(self, counts: DataFrame, sign: int) -> None:
        x = counts.select("column_name", "value", "n", "table_name", "load_no", F.lit(sign).alias("sign"))
        x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name", "load_no", "sign").parquet(self.path)

    def put(self, counts: DataFrame, table: str, loads: Collection[int | None]) -> ValueCounts:
        """Adds the loads of one table, each as one delta in the place of what it had before."""
        for load in loads:
            delete(self.spark, self._folder(table, load, -1))
        self._write(counts, 1)
        return self

    def withdraw(self, table: str, loads: Collection[int | None]) -> ValueCounts:
        """Takes loads away by the same counts with the sign -1; unknown loads have no effect."""
        of = F.lit(False)
        for load in loads:
            of = of | F.col("load_no").eqNullSafe(F.lit(load).cast("int"))
        self._write(self._raw().where((F.col("table_name") == table) & (F.col("sign") == 1) & of), -1)
        return self

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def read(self) -> DataFrame:
        """(table_name, column_name, load_no, value, n): current counts. A load is one delta, in
        which a value stands once; only where one was taken away are deltas summed, and
        what cancels to zero is gone."""
        names = ["table_name", "column_name", "load_no", "value", "n"]
        raw, taken = self._raw(), F.lit(False)
        for folder in matching(self.spark, f"{self.path}/table_name=*/load_no=*/sign=-1"):
            table, load = (x.split("=", 1)[1] for x in folder.rstrip("/").split("/")[-3:-1])
            taken = taken | ((F.col("table_name") == table) & F.col("load_no").eqNullSafe(F.lit(None if load.startswith("__HIVE") else int(load)).cast("int")))
        summed = raw.where(taken).groupBy("table_name", "column_name", "load_no", "value").agg(F.sum(F.col("n") * F.col("sign")).alias("n")).where("n <> 0")
        return raw.where(~taken).select(*names).unionByName(summed.select(*names))

    def sync(self, table: str, df: DataFrame, columns: Sequence[str], load: str | None = "load_no") -> list[int | None]:
        """Brings the store to what ``df`` holds; the loads for which a delta was applied. A
        load is known by its number of rows and the sum of their hashes: one pass without a
        shuffle of values. Loads are deliveries, a bounded few."""
        k = (F.col(load) if load else F.lit(None)).cast("int").alias("load_no")
        prints = df.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).collect()
        now = {json.dumps(r.load_no): f"{r.n}:{r.h}:{','.join(columns)}" for r in prints}
        manifest = f"{self.path}/_loads_{table}.json"
        before = json.loads(read_small(self.spark, manifest) or "{}")
        changed = [json.loads(x) for x in now if before.get(x) != now[x]]
        gone = [json.loads(x) for x in before if x not in now]
        if changed:
            c = value_counts(df, table, columns, load)
            if len(changed) < len(now):
                of = F.lit(False)
                for x in changed:
                    of = of | F.col("load_no").eqNullSafe(F.lit(x).cast("int"))
                c = c.where(of)
            self.put(c, table, changed)
        if gone:
            self.withdraw(table, gone)
        if changed or gone:
            write_small(self.spark, manifest, json.dumps(now))
        return changed + gone

    def compact(self, path: str | None = None) -> ValueCounts:
        """A new store with the deltas summed; the old files stay for their readers."""
        new = ValueCounts(self.spark, path)
        new._write(self.read(), 1)
        return new


def _among(columns: Collection[tuple[str, str]]) -> Column:
    test = F.lit(False)
    for t, c in columns:
        test = test | ((F.col("table_name") == t) & (F.col("column_name") == c))
    return test


def column_profile(counts: DataFrame, formats: dict[tuple[str, str], str] | None = None, numbers: Collection[tuple[str, str]] = ()) -> DataFrame:
    """One row per table and column: rows, nulls (blank counts as null), distinct
    non-null values, least and greatest value, least and greatest length, entropy
    in bits of the non-null values, and values (by row) that violate the format,
    null where the column has none. ``numbers``: columns of whole numbers, whose
    least and greatest value go by number instead of by text.

    A column without any row has no profile row; one with only nulls has null
    ranges and entropy 0.
    """
    by_value = counts.groupBy("table_name", "column_name", "value").agg(F.sum("n").alias("n"))
    v = by_value.select("table_name", "column_name", "n", F.when(~is_blank("value"), F.col("value")).alias("value"))
    bad = F.lit(False)
    for (t, c), pattern in (formats or {}).items():
        bad = bad | ((F.col("table_name") == t) & (F.col("column_name") == c) & ~F.col("value").rlike(f"^(?:{pattern})\\z"))
    there = F.col("value").isNotNull()
    n = F.when(there, F.col("n")).otherwise(0)
    number = F.when(_among(numbers), F.expr("try_cast(value AS bigint)"))
    least, greatest = F.coalesce(F.min_by("value", number), F.min("value")), F.coalesce(F.max_by("value", number), F.max("value"))
    checked = F.when(_among(formats or {}), F.col("n_format"))
    g = v.groupBy("table_name", "column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") - n).alias("n_null"), F.count("value").alias("n_distinct"),
        least.alias("min_value"), greatest.alias("max_value"), F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"),
        F.sum(F.when(there, F.col("n") * F.log2("n"))).alias("_nlogn"), F.sum(n).alias("_n"), F.sum(F.when(there & bad, F.col("n")).otherwise(0)).alias("n_format"))
    # H = log2 N - sum(n log2 n) / N
    entropy = F.when(F.col("_n") > 0, F.greatest(F.log2("_n") - F.col("_nlogn") / F.col("_n"), F.lit(0.0))).otherwise(0.0)
    return g.select("table_name", "column_name", "n_rows", "n_null", (F.col("n_null") / F.col("n_rows")).alias("null_rate"), "n_distinct", "min_value", "max_value", "min_length", "max_length", entropy.alias("entropy_bits"), checked.alias("n_format"))


def load_statistics(counts: DataFrame) -> DataFrame:
    """Per table, column and load, beside the same figures of all other loads
    together (prefix o_): rows, nulls, non-null values, distinct ones, sum of lengths."""
    c = counts.withColumn("there", ~is_blank("value"))
    n = F.when(F.col("there"), F.col("n")).otherwise(0)
    s = c.groupBy("table_name", "column_name", "load_no").agg(F.sum("n").alias("n"), F.sum(n).alias("there"), F.sum(F.when(F.col("there"), 1).otherwise(0)).alias("distinct"), F.sum(n * F.coalesce(F.length("value"), F.lit(0))).alias("chars"))
    # One row per load and column from here on: loads are deliveries, a bounded few.
    t = s.groupBy("table_name", "column_name").agg(F.sum("n").alias("tn"), F.sum("there").alias("tt"), F.sum("chars").alias("tc"))
    return s.join(t, ["table_name", "column_name"]).select("table_name", "column_name", "load_no", "n", (F.col("n") - F.col("there")).alias("nulls"), "there", "distinct", "chars", (F.col("tn") - F.col("n")).alias("o_n"), (F.col("tn") - F.col("tt") - F.col("n") + F.col("there")).alias("o_nulls"), (F.col("tt") - F.col("there")).alias("o_there"), (F.col("tc") - F.col("chars")).alias("o_chars"))


def _null_gap(gap: float) -> Column:
    return F.abs(F.col("nulls") / F.col("n") - F.col("o_nulls") / F.nullif("o_n", F.lit(0))) >= gap - 1e-9


def _mean_lengths() -> tuple[Column, Column]:
    """The mean lengths of a load and of the others times the values of both: as doubles, which
    are exact below 2^53 and never overflow."""
    d = lambda c: F.col(c).cast("double")
    return d("chars") * d("o_there"), d("o_chars") * d("there")


def unusual_loads(counts: DataFrame, kinds: dict[str, Sequence[tuple[str, str]]], min_rows: int = 20, null_gap: float = 0.2, length_ratio: float = 1.5, repeat_ratio: float = 2.0) -> DataFrame:
    """(table_name, column_name, kind, load_no) of loads that differ from all other
    loads together: kind nulls (null rates ``null_gap`` apart), length (mean lengths
    apart by the ratio), repeats (values per distinct value). ``kinds`` names the
    columns of each kind. Loads below ``min_rows`` rows and rows without a load
    number are not judged, though they count among the others."""
    s = load_statistics(counts).where(F.col("load_no").isNotNull() & (F.col("n") >= min_rows))
    gap, here, others = _null_gap(null_gap), *_mean_lengths()
    tests: dict[str, Column] = {
        "nulls": (F.col("o_n") > 0) & gap,
        "length": (F.col("there") > 0) & (F.col("o_there") > 0) & ((here >= F.lit(length_ratio) * others) | (here * F.lit(length_ratio) <= others)),
        "repeats": (F.col("there") > 0) & (F.col("there") >= F.lit(repeat_ratio) * F.col("distinct")),
    }
    found = []
    for kind, cols in kinds.items():
        among = F.lit(False)
        for t, c in cols:
            among = among | ((F.col("table_name") == t) & (F.col("column_name") == c))
        found.append(F.when(among & tests[kind], F.lit(kind)))
    return s.select("table_name", "column_name", "load_no", F.explode(F.array_compact(F.array(*found))).alias("kind")).select("table_name", "column_name", "kind", "load_no")


def _distance(counts: DataFrame, of: Column, name: str) -> DataFrame:
    """Per table, column and load, how far ``of`` is distributed over the load's non-blank
    values from how it is over those of all other loads together; null where there are none.
    <name>_distance: the share that would have to be others (total variation, 0 to 1);
    <name>_divergence: Jensen and Shannon's, 0 to 1 bits; <name>_entropy: bits of the load."""
    key, load = ["table_name", "column_name"], ["table_name", "column_name", "load_no"]
    c = counts.where(~is_blank("value")).withColumn("of", of).groupBy(*load, "of").agg(F.sum("n").alias("n"))
    # A value has one row per load, so windows stay small; so do those over loads.
    c = c.withColumn("o", F.sum("n").over(Window.partitionBy(*key, "of")) - F.col("n"))
    size = c.groupBy(*load).agg(F.sum("n").alias("size"))
    size = size.withColumn("o_size", F.sum("size").over(Window.partitionBy(*key)) - F.col("size"))
    p, q = F.col("n") / F.col("size"), F.col("o") / F.nullif("o_size", F.lit(0))
    part = lambda x: F.coalesce(F.when(x > 0, x * F.log2(2 * x / (p + q))), F.lit(0.0))
    x = c.alias("c").join(size.alias("s"), [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in load])
    others = F.max("o_size") > 0
    # Values that only the others have add half their share each.
    divergence = F.greatest((F.sum(part(p)) + F.sum(part(q)) + 1 - F.sum(q)) / 2, F.lit(0.0))
    return x.groupBy(*[F.col(f"c.{k}") for k in load]).agg(
        F.when(others, F.round(1 - F.sum(F.least(p, q)), 6)).alias(f"{name}_distance"), F.when(others, F.round(divergence, 6)).alias(f"{name}_divergence"), F.round(F.greatest(-F.sum(p * F.log2(p)), F.lit(0.0)), 6).alias(f"{name}_entropy"))


def load_distances(counts: DataFrame) -> DataFrame:
    """load_statistics with the distances of the load's values and of their shapes (letters
    and digits by kind, runs as one) from those of all other loads together."""
    shape = F.col("value")
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "9")):
        shape = F.regexp_replace(shape, pattern, mark)
    # Texts of several words are all of a different shape; their first characters say what they are.
    out = load_statistics(counts)
    for of, name in ((F.col("value"), "value"), (F.substring(shape, 1, 8), "shape")):
        d = _distance(counts, of, name).alias("d")
        on = [F.col(f"x.{k}").eqNullSafe(F.col(f"d.{k}")) for k in ("table_name", "column_name", "load_no")]
        out = out.alias("x").join(d, on, "left").select("x.*", *[f"{name}_{x}" for x in ("distance", "divergence", "entropy")])
    return out


def different_loads(distances: DataFrame, min_rows: int = 20, gap: float = 0.2, ratio: float = 1.5, repeat_ratio: float = 2.0) -> DataFrame:
    """(table_name, column_name, kind, load_no) over every column: kinds nulls and length as
    in unusual_loads; repeats only where the usual (median) load has fewer values per
    distinct value; values and shapes where the distance is ``gap`` above that of the
    usual load. In a column of ids every load has other values, and only shapes,
    repeats, nulls and lengths can differ."""
    s = distances.where(F.col("load_no").isNotNull() & (F.col("n") >= min_rows))
    w = Window.partitionBy("table_name", "column_name")  # one row per load
    per = F.when(F.col("distinct") > 0, F.col("there") / F.col("distinct"))
    s = s.withColumn("per", per).withColumns({f"usual_{c}": F.median(c).over(w) for c in ("per", "value_distance", "shape_distance")})
    mean, others = _mean_lengths()
    tests = {
        "nulls": (F.col("o_n") > 0) & _null_gap(gap),
        "length": (F.col("there") > 0) & (F.col("o_there") > 0) & ((mean >= F.lit(ratio) * others) | (mean * F.lit(ratio) <= others)),
        "repeats": (F.col("per") >= repeat_ratio) & (F.col("usual_per") < repeat_ratio),
        "values": F.col("value_distance") - F.col("usual_value_distance") >= gap,
        "shapes": F.col("shape_distance") - F.col("usual_shape_distance") >= gap,
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return s.select("table_name", "column_name", "load_no", F.explode(found).alias("kind")).select("table_name", "column_name", "kind", "load_no")


def format_violations(counts: DataFrame, formats: dict[tuple[str, str], str]) -> DataFrame:
    """(table_name, column_name, value): maintained non-blank values that do not match
    their column's pattern as a whole. Each distinct value is tested once."""
    v = counts.select("table_name", "column_name", "value").where(~is_blank("value"))
    bad = F.lit(False)
    for (t, c), pattern in formats.items():
        bad = bad | ((F.col("table_name") == t) & (F.col("column_name") == c) & ~F.col("value").rlike(f"^(?:{pattern})\\z"))
    return v.where(bad).distinct()


def load_store(tables: dict[str, tuple[DataFrame, Sequence[str]]], path: str | None = None) -> ValueCounts:
    """The store at ``path`` brought to what the tables hold, one delta per load. A table
    without load_no is one load."""
    spark = next(iter(tables.values()))[0].sparkSession
    store = ValueCounts(spark, path)
    for name, (df, cols) in tables.items():
        store.sync(name, df, cols, "load_no" if "load_no" in df.columns else None)
    return store


__all__ = ["ValueCounts", "value_counts", "column_profile", "load_statistics", "load_distances", "different_loads", "unusual_loads", "format_violations", "load_store"]
