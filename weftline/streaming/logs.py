"""Message and event logs: next steps, truncation, usage, failures, tails; batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import strip, tag_block
from weftline.operators.rows import first_and_last


#: The tags of responses, and what a code block's first line says of its language.
THINK, EXECUTE, SOLUTION = ("think", "execute", "solution")
LANGUAGE_MARKERS = {"#!R": "r", "# R code": "r", "# R script": "r", "#!BASH": "bash", "# Bash script": "bash", "#!CLI": "bash"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _has(c: Column, tag: str) -> Column:
    return c.rlike(rf"(?s)<{tag}>.*?</{tag}>")


def _outside_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def _closed(c: Column, seen: Column, tag: str) -> Column:
    """c with the tag's end appended if ``seen`` has its beginning alone."""
    return F.when(seen.contains(f"<{tag}>") & ~seen.contains(f"</{tag}>"), F.concat(c, F.lit(f"</{tag}>"))).otherwise(c)


def repair_tags(text: Column | str) -> Column:
    """A closing tag appended for each opening tag without one, stripped. Tags named
    inside closed think blocks are not looked at."""
    c = _c(text)
    out = _outside_think(c)
    for t in (EXECUTE, SOLUTION):
        c, out = _closed(c, out, t), _closed(out, out, t)
    return strip(_closed(c, c, THINK))


def next_step(text: Column | str, errors: Column | None = None) -> Column:
    """What a response asks for, after repair and without its think blocks: end if it has
    a solution block, execute if it has an execute block, else generate (again)
    with a think block or without any tag. ``errors``: how often responses without
    tags were sent back before; from two on, such a response ends. Null text gives null."""
    c = _c(text)
    out = _outside_think(c)
    for t in (EXECUTE, SOLUTION):
        out = _closed(out, out, t)
    thinks = _has(_closed(c, c, THINK), THINK)
    given_up = F.coalesce(errors >= 2, F.lit(False)) if errors is not None else F.lit(False)
    return F.when(c.isNull(), None).when(_has(out, SOLUTION), "end").when(_has(out, EXECUTE), "execute").when(thinks, "generate").when(given_up, "end").otherwise("generate")


def pending_code(text: Column | str) -> Column:
    """The first execute block outside think blocks, stripped; null where the step is not execute."""
    out = _outside_think(_c(text))
    for t in (EXECUTE, SOLUTION):
        out = _closed(out, out, t)
    return F.when(~_has(out, SOLUTION) & _has(out, EXECUTE), strip(F.regexp_extract(out, r"(?s)<execute>(.*?)</execute>", 1)))


def truncate_messages(messages: DataFrame, keep: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The first message of a conversation and its last ``keep`` - 1 ones."""
    return first_and_last(messages, conversation, turn, keep)


def code_language(code: Column | str) -> Column:
    """Of a code block, by what it begins with."""
    c, out = _c(code), F.lit("python")
    for marker, language in reversed(LANGUAGE_MARKERS.items()):
        out = F.when(F.startswith(c, F.lit(marker)), language).otherwise(out)
    return out


def without_marker(code: Column | str) -> Column:
    """A code block without its language marker, stripped; Python code as it is."""
    c = _c(code)
    out = c
    for marker in LANGUAGE_MARKERS:
        out = F.when(F.startswith(c, F.lit(marker)), strip(F.substring(c, F.lit(len(marker) + 1), F.length(c)))).otherwise(out)
    return out


def solution(text: Column | str, most: int = 2000) -> Column:
    """The solution block; without one, the text without its think, execute and
    observation blocks, or the whole text where nothing else is left. Stripped, cut
    to ``most`` characters."""
    c = _c(text)
    rest = F.left(strip(F.regexp_replace(c, r"(?s)<(?:think|execute|observation)>.*?</(?:think|execute|observation)>", "")), F.lit(most))
    return F.coalesce(tag_block(c, SOLUTION, most), F.when(rest != "", rest), F.left(strip(c), F.lit(most)))


def filter_events(events: DataFrame, types: Sequence[str], column: str = "event_type") -> DataFrame:
    """Events of the given types; all, if none are given. Works on streams alike."""
    return events.where(F.col(column).isin(list(types))) if types else events


def usage(json_text: Column | str) -> Column:
    """struct<model, input, output, total, cache_write, cache_read, thinking, cost, currency>
    from usage records in any of their spellings: counters at the top, or in the
    first of token_usage, usage and response.usage that is an object.

    A zero or an empty text is passed over like a missing value, except as the last
    choice; what is nowhere is null. total falls back on the sum of input and
    output where both are there. Numbers may be written as text.
    """
    c = _c(json_text)
    get = lambda j, *ps: [F.get_json_object(j, f"$.{p}") for p in ps]
    objects = [F.when(F.startswith(F.ltrim(x), F.lit("{")), x) for x in get(c, "token_usage", "usage", "response.usage")]
    u = F.coalesce(*objects)
    # A record's usage counts only where it is an object itself.
    own = objects[1]

    def pick(kind: str, *xs: Column) -> Column:
        some = [F.when((x != "") & F.coalesce(x.try_cast("double") != 0, F.lit(True)), x) for x in xs[:-1]]
        v = F.coalesce(*some, xs[-1])
        # Whole numbers are cut, not rounded, where written with decimals.
        return (F.coalesce(v.try_cast("bigint"), F.when(v.contains("."), v.try_cast("double")).try_cast("bigint")) if kind == "bigint" else v.try_cast(kind)) if kind != "string" else v

    i = pick("bigint", *get(c, "prompt_eval_count"), *get(u, "prompt_tokens", "input_tokens", "inputTokens"), *get(c, "inputTokens", "input_tokens"), *get(own, "prompt_tokens", "input_tokens"))
    o = pick("bigint", *get(c, "eval_count"), *get(u, "completion_tokens", "output_tokens", "outputTokens"), *get(c, "outputTokens", "output_tokens"), *get(own, "completion_tokens", "output_tokens"))
    t = pick("bigint", *get(u, "total_tokens", "totalTokens"), *get(c, "totalTokens", "total_tokens"), *get(own, "total_tokens"))
    cost = pick("double", *get(u, "total_cost", "cost", "totalCost"), *get(c, "total_cost", "cost", "totalCost"), *get(own, "total_cost", "cost", "estimated_cost"))
    return F.struct(
        pick("string", *get(c, "model", "model_name", "modelId")).alias("model"), i.alias("input"), o.alias("output"), F.coalesce(t, i + o).alias("total"),
        pick("bigint", *get(u, "cache_creation_input_tokens", "cacheCreationInputTokens")).alias("cache_write"),
        pick("bigint", *get(u, "cache_read_input_tokens", "cacheReadInputTokens", "prompt_tokens_details.cached_tokens")).alias("cache_read"),
        pick("bigint", *get(u, "thinking_input_tokens")).alias("thinking"), cost.alias("cost"), pick("string", *get(c, "currency"), *get(u, "currency")).alias("currency"))


def usage_totals(records: DataFrame, group: str, amount: str) -> DataFrame:
    return records.groupBy(group).agg(F.sum(F.coalesce(amount, F.lit(0))).alias("total"), F.count(F.lit(1)).alias("n"))


def running_budget(records: DataFrame, run: str, order: str, amount: str, budget: float) -> DataFrame:
    """Running total per run, and whether it has passed the budget."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("running_total", F.sum(F.coalesce(amount, F.lit(0))).over(w)).withColumn("over_budget", F.col("running_total") > budget)


def failure_streaks(records: DataFrame, run: str, order: str, failed: Column) -> DataFrame:
    """Consecutive failures up to each record; a success resets the count."""
    w = Window.partitionBy(run).orderBy(order)
    f = F.coalesce(failed.cast("int"), F.lit(0))
    island = F.sum(1 - f).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = records.withColumn("_i", island).withColumn("_f", f)
    return x.withColumn("consecutive_failures", F.sum("_f").over(Window.partitionBy(run, "_i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_i", "_f")


def run_ends(records: DataFrame, run: str, order: str, cost: str, failed: Column, max_iterations: int | None = None, max_cost: float | None = None, max_failures: int | None = None) -> DataFrame:
    """Per record of a run, whether the run had to end before it and why (ended_by):
    max_iterations, max_cost (what was spent before reaches the budget) or
    max_failures (so many failures in a row right before it); null otherwise.
    A limit of None never ends a run."""
    w = Window.partitionBy(run).orderBy(order)
    x = failure_streaks(records, run, order, failed)
    before = F.coalesce(F.sum(F.coalesce(cost, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    streak = F.coalesce(F.lag("consecutive_failures").over(w), F.lit(0))
    tests = [(F.row_number().over(w) > max_iterations, "max_iterations")] if max_iterations is not None else []
    tests += [(before >= max_cost, "max_cost")] if max_cost is not None else []
    tests += [(streak >= max_failures, "max_failures")] if max_failures is not None else []
    why = F.coalesce(*[F.when(t, F.lit(name)) for t, name in tests], F.lit(None).cast("string"))
    return x.withColumn("ended_by", why)


def last_results(messages: DataFrame, run: str, agent: str, order: str, result: str) -> DataFrame:
    """(run, agent, result): what each agent of a run answered last; earlier answers are overwritten."""
    return messages.groupBy(run, agent).agg(F.max_by(result, order).alias(result))


def tail(events: DataFrame, group: str, order: Sequence[Column | str], keep: int) -> DataFrame:
    """The last ``keep`` events per group."""
    w = Window.partitionBy(group).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def index_list(text: Column | str, label: str) -> Column:
    """array<int> of a list `LABEL: [1, 2, x]` in a text; malformed entries are left out."""
    c = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_extract(c, rf"(?i){label}:\s*\[(.*?)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda s: F.trim(s).try_cast("int")), lambda i: i.isNotNull())


def select_by_index(requests: DataFrame, catalog: DataFrame, indexes: str, position: str = "pos") -> DataFrame:
    """Catalog rows whose position is in the list; positions out of bounds give none."""
    return requests.select("*", F.explode(indexes).alias(position)).join(catalog, position)


def catalog_filter(catalog: DataFrame, module: str | None = None, category: str | None = None, fmt: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Entries of a registry by part of the module, category, format, or names."""
    if module:
        catalog = catalog.where(F.col("module").contains(module))
    if category:
        catalog = catalog.where(F.col("category") == category)
    if fmt:
        catalog = catalog.where(F.lower("format") == fmt.lower())
    return catalog.where(F.col("name").isin(list(names))) if names is not None else catalog


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Entries and distinct categories per kind of resource."""
    return catalog.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("category")).alias("categories"))


def write_registry(catalog: DataFrame, folder: str) -> None:
    """Registry entries as JSON lines, without the ids of tools: those are given anew on reading."""
    catalog.drop("id").write.mode("overwrite").json(folder)


def read_registry(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Entries as written, tools numbered from 0 by name; other kinds have no id."""
    x = spark.read.schema(schema).json(folder)
    # A registry is catalog-sized; the window is over its tools only.
    return x.withColumn("id", F.when(F.col("kind") == "tool", F.row_number().over(Window.partitionBy("kind").orderBy("name")) - 1))


def embedded_graph(text: Column | str) -> Column:
    """struct<nodes, links> of the first JSON object with nodes in a text, null without."""
    c = F.col(text) if isinstance(text, str) else text
    schema = "nodes array<struct<id:string,label:string>>, links array<struct<source:string,target:string>>"
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\"nodes\".*\})", 1), schema)


def merge_graph(nodes: DataFrame, new_nodes: DataFrame, links: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id (old ones stay), links appended as they come."""
    fresh = new_nodes.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(fresh, allowMissingColumns=True), links.unionByName(new_links, allowMissingColumns=True)


EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, folder: str, schema: T.StructType = EVENT, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def windowed_usage(events: DataFrame, types: Sequence[str] = (), window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and totals per window and type; rows later than the watermark are dropped,
    state older than it is given up. For batch and streaming input alike."""
    e = filter_events(events, types)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
