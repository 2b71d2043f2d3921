"""Queries over the driver's tables, one for each operator or group of them; SQL is
given beside each in ``SQL``. The business tables stand in for sources: customers,
orders, parts, suppliers, nations and regions are nodes, their keys are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import nested as n
from weftline.functions import text as x
from weftline.graph import algo, build, catalog, export
from weftline.graph.mapping import EdgeMapping, NodeMapping
from weftline.metrics import graph as gm
from weftline.metrics import tables as tm
from weftline.operators import enrichment, rows
from weftline.operators.hierarchy import hierarchy
from weftline.operators.peg import XREFS, split_values
from weftline.plans.tables import table
from weftline.storage import scratch_path
from weftline.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ALL = ", ".join(LINE_ORDER)


# The flagship: counts of distinct keys, a threshold, an override, an order

@query("""WITH often AS (SELECT p_brand, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand HAVING count(DISTINCT l_orderkey) > 20),
promo AS (SELECT DISTINCT p_brand FROM part WHERE p_type LIKE 'PROMO%')
SELECT p_brand, coalesce(n_orders, 0) AS n_orders, CASE WHEN promo.p_brand IS NOT NULL THEN 'promo' ELSE 'often' END AS label FROM often FULL JOIN promo USING (p_brand)""")
def slim_terms(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    often = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("n_orders")).where("n_orders > 20")
    promo = part.where(F.startswith("p_type", F.lit("PROMO"))).select("p_brand").distinct().join(often, "p_brand", "left").select("p_brand", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.lit("promo").alias("label"))
    return rows.override_union(often.withColumn("label", F.lit("often")), promo, "p_brand", ["label"]).orderBy("p_brand")


# Choosing rows

@query(f"SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ALL}) AS rn FROM lineitem) WHERE rn = 1")
def keep_first(s, d):
    return rows.keep_first(table(s, d, "lineitem"), ["l_partkey"], LINE_ORDER).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query(f"SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1")
def keep_last(s, d):
    return rows.keep_last(table(s, d, "lineitem"), ["l_suppkey"], LINE_ORDER).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def full_row_distinct(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query("SELECT o_custkey, arg_min(o_orderpriority, (o_orderpriority, o_orderkey)) AS best, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS best_order FROM orders GROUP BY o_custkey")
def priority_argmin(s, d):
    rank = F.struct("o_orderpriority", "o_orderkey")
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", rank).alias("best"), F.min_by("o_orderkey", rank).alias("best_order"))


@query("SELECT s_nationkey AS key, s_name AS name, 'supplier' AS kind FROM supplier WHERE s_nationkey < 12 UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 12)")
def override_union(s, d):
    sup = table(s, d, "supplier").where("s_nationkey < 12")
    base = table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    hit = base.join(sup.select(F.col("s_nationkey").alias("key")).distinct(), "key", "left_anti")
    return sup.select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")).unionByName(hit)


# Aggregates

@query("SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS a_line, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS r_line, max(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS n_line FROM lineitem GROUP BY l_orderkey")
def id_pivot(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_returnflag") == f, F.col("l_linenumber"))).alias(f"{f.lower()}_line") for f in "ARN"])


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, 'P - ' || string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY p_brand")
def ordered_string_agg(s, d):
    ordered = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return table(s, d, "part").groupBy("p_brand").agg(ordered("p_type").alias("types"), F.concat(F.lit("P - "), ordered("p_size")).alias("sizes"))


@query("SELECT p_type, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type HAVING count(DISTINCT l_orderkey) > 100")
def distinct_having(s, d):
    p = table(s, d, "part").select("p_partkey", "p_type")
    return table(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.countDistinct("l_orderkey").alias("n")).where("n > 100")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null, max(value) AS top FROM events GROUP BY event_type")
def value_counts(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_if(F.col("value").isNull()).alias("n_null"), F.max("value").alias("top"))


@query("SELECT n_regionkey, sum(n * (n - 1) // 2)::BIGINT AS pairs, max(n) AS most FROM (SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY n_regionkey")
def pair_counting(s, d):
    c = table(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return table(s, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.max("n").alias("most"))


@query("WITH t AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, arg_min(p_type, (-n, p_type)) AS dominant FROM t GROUP BY p_brand")
def argmax_count(s, d):
    t = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("p_brand").agg(F.min_by("p_type", F.struct(-F.col("n"), "p_type")).alias("dominant"))


@query("SELECT user_id, sum(coalesce(value, 0)) AS total, count(*) AS n FROM events GROUP BY user_id")
def usage_totals(s, d):
    return logs.usage_totals(table(s, d, "events"), "user_id", "value")


# Joins

@query("SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, p_name, s_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")
def two_sided_lookup(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    a = rows.lookup(li, table(s, d, "part").where("p_size > 25"), "l_partkey", "p_partkey", "p_name", "p_name")
    return rows.lookup(a, table(s, d, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey", "s_name", "s_name")


@query("SELECT c_custkey, c_name, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def enrich_left(s, d):
    return rows.lookup(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), table(s, d, "nation").where("n_regionkey < 3"), "c_nationkey", "n_nationkey", "n_name", "n_name", "").drop("c_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity, p_brand, s_nationkey FROM lineitem JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size > 10) ON p_partkey = l_partkey JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 100) ON s_suppkey = l_suppkey")
def two_ends_resolved(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    a = rows.lookup(li, table(s, d, "part").where("p_size > 10"), "l_partkey", "p_partkey", "p_brand", "p_brand")
    return rows.lookup(a, table(s, d, "supplier").where("s_acctbal > 100"), "l_suppkey", "s_suppkey", "s_nationkey", "s_nationkey").na.drop(subset=["p_brand", "s_nationkey"]).drop("l_partkey", "l_suppkey")


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_and_anti(s, d):
    o = table(s, d, "orders")
    c = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    li = table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(c, "o_custkey", "left_semi").join(li, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT start_id AS value FROM graph_edges WHERE start_id IS NOT NULL AND start_id NOT IN (SELECT id FROM graph_nodes WHERE id IS NOT NULL) ORDER BY value LIMIT 15")
def unmatched_sample(s, d):
    """The first of the starts that no node has, as a log shows them."""
    return rows.unmatched(table(s, d, "graph_edges"), table(s, d, "graph_nodes"), "start_id", "id", 15)


@query("SELECT 'suppliesTo' AS rel_type, 'supplier_' || s_suppkey AS start_id, 'customer_' || c_custkey AS end_id FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def edge_resolution(s, d):
    ns, es, tabs = _trade_mappings(s, d)
    nodes = build.build_nodes(tabs, ns)
    return build.build_edges(tabs, es[:1], nodes).select("rel_type", "start_id", "end_id")


@query("SELECT 'placed' AS rel_type, 'customer_' || o_custkey AS start_id, 'order_' || o_orderkey AS end_id FROM orders UNION ALL SELECT 'placedBy', 'order_' || o_orderkey, 'customer_' || o_custkey FROM orders")
def inverse_edges(s, d):
    e = table(s, d, "orders").select(F.lit("placed").alias("rel_type"), F.concat(F.lit("customer_"), "o_custkey").alias("start_id"), F.concat(F.lit("order_"), "o_orderkey").alias("end_id"))
    return build.with_inverse(e, "placedBy")


@query("""WITH a AS (SELECT c_nationkey || ':' || substr(c_name, -2) AS k, max(c_name) AS name, max(c_acctbal) AS bal FROM customer GROUP BY 1), b AS (SELECT s_nationkey || ':' || substr(s_name, -2) AS k, max(s_name) AS name, max(s_name) AS sname FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, bal, sname FROM a FULL JOIN b ON a.k = b.k""")
def merge_upsert(s, d):
    key = lambda p: F.concat(F.col(f"{p}_nationkey").cast("string"), F.lit(":"), F.substring(f"{p}_name", -2, 2))
    a = table(s, d, "customer").groupBy(key("c").alias("k")).agg(F.max("c_name").alias("name"), F.max("c_acctbal").alias("bal"))
    b = table(s, d, "supplier").groupBy(key("s").alias("k")).agg(F.max("s_name").alias("name"), F.max("s_name").alias("sname"))
    return rows.merge_upsert(a, b, "k")


@query("""SELECT DISTINCT doc_id, a, b FROM (SELECT doc_id, unnest(list_filter(string_split(lower(text), ' '), lambda w: length(w) = 12)) AS a, string_split(lower(text), ' ') AS ws FROM documents), unnest(list_filter(ws, lambda w: length(w) = 13)) AS t(b)""")
def nested_cross(s, d):
    ws = F.split(F.lower("text"), " ")
    t = table(s, d, "documents").select("doc_id", F.explode(F.filter(ws, lambda w: F.length(w) == 12)).alias("a"), ws.alias("ws"))
    return t.select("doc_id", "a", F.explode(F.filter("ws", lambda w: F.length(w) == 13)).alias("b")).distinct()


# Filters

@query("SELECT doc_id, lang, source FROM documents WHERE coalesce(lang = 'de', false) OR coalesce(source IN ('abstracts', 'case_notes'), false) OR coalesce(contains(lower(text), 'anomaly'), false) OR coalesce(contains(lower(text), 'disorder'), false)")
def scope_filter(s, d):
    from weftline.sources.tables import in_scope

    scope = {"ids": ["de"], "source": ["abstracts", "case_notes"], "terms": ["anomaly", "disorder"]}
    return table(s, d, "documents").where(in_scope(F.col("lang"), F.col("text"), scope, {"source": F.array("source")})).select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') AND NOT list_has_any(string_split(p_name, ' '), ['small', 'red'])")
def tag_include_exclude(s, d):
    return table(s, d, "part").where(n.tagged(F.split("p_name", " "), "ring", ["small", "red"])).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type, p_size FROM part WHERE CAST(p_size AS VARCHAR) = '15' OR p_type LIKE 'ECONOMY%' OR regexp_matches(p_name, '[0-9]{2}$') AND p_retailprice > 950.0")
def predicates(s, d):
    from weftline.sources.readers import gt

    return table(s, d, "part").where((F.col("p_size").cast("string") == "15") | F.startswith("p_type", F.lit("ECONOMY")) | (F.col("p_name").rlike("[0-9]{2}$") & gt("p_retailprice", 950.0))).select("p_partkey", "p_type", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > l_quantity * 1500 AND l_quantity >= 3 AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL")
def column_comparison(s, d):
    return table(s, d, "lineitem").where((F.col("l_extendedprice") > F.col("l_quantity") * 1500) & (F.col("l_quantity") >= 3) & F.col("l_returnflag").isin("A", "R") & F.col("l_shipdate").isNotNull()).select("l_orderkey", "l_linenumber", "l_extendedprice")


# Text and nested values

_XREFS = "list_filter(regexp_extract_all(dbXrefs, '[\\p{L}\\p{M}\\p{N}:./_\\-]+'), lambda e: contains(e, ':'))"


@query(f"SELECT row_id, GeneID, list_last(list_transform(list_filter({_XREFS}, lambda e: e LIKE 'HGNC:%'), lambda e: e[6:])) AS hgnc, list_last(list_transform(list_filter({_XREFS}, lambda e: e LIKE 'MIM:%'), lambda e: e[5:])) AS mim FROM genes")
def kv_map_expand(s, d):
    """Every row, however its entries are parted."""
    entries = F.transform(split_values("dbXrefs", XREFS), lambda v: v["value"])
    g = table(s, d, "genes").select("row_id", "GeneID", n.entry_map(entries).alias("m"))
    return g.select("row_id", "GeneID", F.col("m")["HGNC"].alias("hgnc"), F.col("m")["MIM"].alias("mim"))


#: Usage records in the spellings of several services, made of events; some counters are zero, missing or text.
_USAGE = [
    """{"model": "a", "usage": {"prompt_tokens": K, "completion_tokens": E, "total_tokens": 0, "prompt_tokens_details": {"cached_tokens": 7}}}""",
    """{"modelId": "b", "inputTokens": K, "outputTokens": E, "totalTokens": 5, "totalCost": 0.25, "currency": "EUR"}""",
    """{"model": "", "model_name": "c", "prompt_eval_count": 0, "eval_count": E, "input_tokens": K}""",
    """{"token_usage": {"input_tokens": "K", "output_tokens": E, "cache_creation_input_tokens": 3, "thinking_input_tokens": 4, "cost": 0}, "usage": {"input_tokens": 1, "cost": 2}}""",
    """{"response": {"usage": {"inputTokens": K, "outputTokens": 0, "currency": "USD"}}, "total_cost": "1.5"}""",
    """{"usage": [1, 2], "total_tokens": K}""",
    "no json K E",
]


def _first(*xs: str) -> str:
    """Of JSON texts, the first that is neither missing, empty nor zero; else the last."""
    falsy = lambda x: f"({x} = '' OR coalesce(try_cast({x} AS DOUBLE) = 0, false))"
    return "coalesce(" + ", ".join([f"CASE WHEN NOT {falsy(x)} THEN {x} END" for x in xs[:-1]] + [xs[-1]]) + ")"


def _at(j: str, *paths: str) -> list[str]:
    return [f"json_extract_string({j}, '$.{p}')" for p in paths]


_KINDS = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_USAGE))


@query(f"""WITH t AS (SELECT event_id, replace(replace(CASE event_id % {len(_USAGE)} {_KINDS} END, 'K', CAST(event_id % 90 AS VARCHAR)), 'E', CAST(event_id % 7 AS VARCHAR)) AS raw FROM events),
r AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM t),
o AS (SELECT event_id, j, CASE WHEN json_type(j, '$.usage') = 'OBJECT' THEN json_extract(j, '$.usage') END AS own, CASE WHEN json_type(j, '$.token_usage') = 'OBJECT' THEN json_extract(j, '$.token_usage') WHEN json_type(j, '$.usage') = 'OBJECT' THEN json_extract(j, '$.usage') WHEN json_type(j, '$.response.usage') = 'OBJECT' THEN json_extract(j, '$.response.usage') END AS u FROM r),
x AS (SELECT event_id, {_first(*_at('j', 'model', 'model_name', 'modelId'))} AS model,
  try_cast({_first(*_at('j', 'prompt_eval_count'), *_at('u', 'prompt_tokens', 'input_tokens', 'inputTokens'), *_at('j', 'inputTokens', 'input_tokens'), *_at('own', 'prompt_tokens', 'input_tokens'))} AS BIGINT) AS input,
  try_cast({_first(*_at('j', 'eval_count'), *_at('u', 'completion_tokens', 'output_tokens', 'outputTokens'), *_at('j', 'outputTokens', 'output_tokens'), *_at('own', 'completion_tokens', 'output_tokens'))} AS BIGINT) AS output,
  try_cast({_first(*_at('u', 'total_tokens', 'totalTokens'), *_at('j', 'totalTokens', 'total_tokens'), *_at('own', 'total_tokens'))} AS BIGINT) AS total,
  try_cast({_first(*_at('u', 'cache_creation_input_tokens', 'cacheCreationInputTokens'))} AS BIGINT) AS cache_write, try_cast({_first(*_at('u', 'cache_read_input_tokens', 'cacheReadInputTokens', 'prompt_tokens_details.cached_tokens'))} AS BIGINT) AS cache_read,
  try_cast({_at('u', 'thinking_input_tokens')[0]} AS BIGINT) AS thinking, try_cast({_first(*_at('u', 'total_cost', 'cost', 'totalCost'), *_at('j', 'total_cost', 'cost', 'totalCost'), *_at('own', 'total_cost', 'cost', 'estimated_cost'))} AS DOUBLE) AS cost, {_first(*_at('j', 'currency'), *_at('u', 'currency'))} AS currency FROM o)
SELECT event_id, model, input, output, coalesce(total, input + output) AS total, cache_write, cache_read, thinking, cost, currency FROM x""")
def usage_records(s, d):
    kind, e = F.pmod("event_id", F.lit(len(_USAGE))), table(s, d, "events")
    raw = F.element_at(F.array(*map(F.lit, _USAGE)), (kind + 1).cast("int"))
    raw = F.replace(F.replace(raw, F.lit("K"), F.pmod("event_id", F.lit(90)).cast("string")), F.lit("E"), F.pmod("event_id", F.lit(7)).cast("string"))
    return e.select("event_id", logs.usage(raw).alias("u")).select("event_id", "u.*")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT doc_id, len(v) AS n, array_to_string(v, '|') AS found FROM (SELECT doc_id, regexp_extract_all(text, '([A-Z]{2,4}[0-9]{2})', 1) AS v FROM documents WHERE text IS NOT NULL)")
def regex_extract_all(s, d):
    v = F.regexp_extract_all("text", F.lit("([A-Z]{2,4}[0-9]{2})"), F.lit(1))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(v).cast("long").alias("n"), F.array_join(v, "|").alias("found"))


@query("SELECT DISTINCT interaction AS i, split_part(interaction, '^', 1) AS verb, split_part(interaction, '^', 2) AS what FROM (SELECT unnest(string_split(InteractionActions, '|')) AS interaction FROM ctd_interactions)")
def nested_entries(s, d):
    e = table(s, d, "ctd_interactions").select(F.explode(n.split_entries("InteractionActions", least=2)).alias("e")).distinct()
    return e.select(F.array_join("e", "^").alias("i"), F.col("e")[0].alias("verb"), F.col("e")[1].alias("what"))


_ONE = "trim(regexp_replace({c}, '[\\r\\n\\t]+', ' ', 'g'))"
_QUOTED = """'"' || definition || ' [see ' || row_id || ']." [' || source_database || ']'"""


@query(f"""WITH t AS (SELECT row_id, {_QUOTED} AS s FROM disease_nodes WHERE definition IS NOT NULL), u AS (SELECT row_id, CASE WHEN starts_with(s, '"') THEN s[2:] ELSE s END AS s FROM t)
SELECT row_id, {_ONE.format(c="regexp_replace(regexp_replace(s, '(?s)^(.*) \\[.*$', '\\1'), '" + chr(34) + "+$', '')")} AS before_last, {_ONE.format(c="regexp_replace(split_part(s, ' [', 1), '" + chr(34) + "$', '')")} AS before_first, regexp_extract('"' || s, '(?s)^"(.*?)"', 1) AS quoted FROM u""")
def definition_clean(s, d):
    t = table(s, d, "disease_nodes").where("definition is not null").select("row_id", F.expr(_QUOTED).alias("s"))
    return t.select("row_id", x.definition_before_last_bracket("s").alias("before_last"), x.definition_before_first_bracket("s").alias("before_first"), x.first_quoted("s").alias("quoted"))


@query("SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9_\\-.:]', '_', 'g') AS slug, CASE WHEN c_mktsegment LIKE 'M%' THEN c_mktsegment ELSE 'M:' || c_mktsegment END AS prefixed, regexp_replace(c_name, '^Customer', '') AS short FROM customer")
def text_keys(s, d):
    return table(s, d, "customer").select("c_custkey", x.slug("c_name").alias("slug"), F.when(F.startswith("c_mktsegment", F.lit("M")), F.col("c_mktsegment")).otherwise(F.concat(F.lit("M:"), "c_mktsegment")).alias("prefixed"), x.drop_prefix("c_name", "Customer").alias("short"))


@query("SELECT edge_id, props['evidence'] AS evidence, CAST(props['score'] AS DOUBLE) AS score FROM graph_edges WHERE props['score'] IS NOT NULL")
def map_fields(s, d):
    return table(s, d, "graph_edges").select("edge_id", F.col("props")["evidence"].alias("evidence"), F.col("props")["score"].try_cast("double").alias("score")).where("score is not null")


@query("SELECT doc_id, upper(trim(coalesce(source, ''), E' \\t\\n\\r')) AS src, CASE WHEN regexp_full_match(topic_id, 'MONDO:[0-9]+') THEN 1 ELSE 0 END AS has_topic FROM documents")
def normalized_sources(s, d):
    return table(s, d, "documents").select("doc_id", F.upper(x.strip(F.coalesce("source", F.lit("")))).alias("src"), F.coalesce(F.col("topic_id").rlike("^MONDO:[0-9]+$"), F.lit(False)).cast("int").alias("has_topic"))


# Sets

@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM doc_labels) UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM doc_labels) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM doc_labels)")
def set_ops(s, d):
    a, b = table(s, d, "documents").select("doc_id"), table(s, d, "doc_labels").select("doc_id")
    c = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return c(a.intersect(b), "both").unionByName(c(a.subtract(b), "only")).unionByName(c(a.union(b).distinct(), "either"))


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def bag_append(s, d):
    return rows.bag_append(table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


# Co-occurrence

_COOC = """o AS (SELECT DISTINCT p_brand AS e, l_orderkey AS doc FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT e, count(*) AS n FROM o GROUP BY e), c AS (SELECT count(DISTINCT doc) AS corpus FROM o),
pr AS (SELECT a.e AS source_id, b.e AS target_id, count(*) AS a FROM o a JOIN o b USING (doc) WHERE a.e < b.e GROUP BY ALL),
st AS (SELECT source_id, target_id, a, s.n AS ns, t.n AS nt, corpus, greatest(corpus - s.n - t.n + a, 0) AS d FROM pr JOIN m s ON s.e = source_id JOIN m t ON t.e = target_id, c)"""


def _brand_docs(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("e"))
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("e", F.col("l_orderkey").alias("doc"))


def _pairs(s, d):
    o = _brand_docs(s, d)
    return enrichment.pair_statistics(o.select(F.col("e").alias("source_id"), "doc"), o.select(F.col("e").alias("target_id"), "doc"), o.select("doc").distinct().count(), upper_triangle=True)


@query(f"WITH {_COOC} SELECT source_id, target_id, a AS cooccurrence, round(a * corpus / (ns * nt), 4) AS enrichment, CASE WHEN (ns - a) * (nt - a) = 0 THEN 'inf'::DOUBLE ELSE round(a * d / ((ns - a) * (nt - a)), 6) END AS odds_ratio FROM st")
def cooccurrence(s, d):
    return _pairs(s, d).drop("p_fisher")


@query(f"""WITH {_COOC}, t AS (SELECT source_id, target_id, a, ns, nt, ns + nt - a + d AS big, unnest(range(a, least(ns, nt) + 1)) AS k FROM st)
SELECT source_id, target_id, round(least(sum(exp(lgamma(ns + 1) - lgamma(k + 1) - lgamma(ns - k + 1) + lgamma(big - ns + 1) - lgamma(nt - k + 1) - lgamma(big - ns - nt + k + 1) - lgamma(big + 1) + lgamma(nt + 1) + lgamma(big - nt + 1))), 1.0), 6) AS p_fisher FROM t WHERE nt - k <= big - ns GROUP BY source_id, target_id""")
def fisher(s, d):
    return _pairs(s, d).select("source_id", "target_id", F.round("p_fisher", 6).alias("p_fisher"))


def dimension_products(s: SparkSession, d: str) -> DataFrame:
    """(i, j, score): the products of two dimensions, summed over all vectors."""
    v = table(s, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select("v", F.posexplode("v").alias("i", "x")).select("i", "x", F.posexplode("v").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS score FROM v a JOIN v b USING (vec_id) GROUP BY ALL)
SELECT 'd' || i AS source_hgnc, 'd' || j AS target_hgnc, round(score, 6) AS erc_score, 'ERC' AS source_database FROM m WHERE i < j AND score >= 0.5""")
def matrix_upper(s, d):
    """The products of the embeddings' dimensions over all vectors, a square matrix, as pairs."""
    from weftline.sources.tables import rate_covariation

    m = dimension_products(s, d).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "score"))), lambda c: c["score"]).alias("scores"))
    return rate_covariation(m, [f"d{i}" for i in range(64)], 0.5)["gene_covariation"].withColumn("erc_score", F.round("erc_score", 6))


# Graph

def _trade_mappings(s, d):
    tabs = {k: table(s, d, k) for k in ("customer", "supplier", "nation", "region", "orders")}
    ns = [
        NodeMapping("suppliers", "Supplier", "supplier", "s_suppkey", {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation"}),
        NodeMapping("customers", "Customer", "customer", "c_custkey", {"c_custkey": "key", "c_name": "name", "c_nationkey": "nation"}),
        NodeMapping("nations", "Nation", "nation", "n_nationkey", {"n_nationkey": "key", "n_name": "name"}),
        NodeMapping("nation_labels", "Nation", "region", "r_regionkey", {"r_regionkey": "key", "r_name": "label"}, merge_on="key"),
    ]
    es = [
        EdgeMapping("trade", "suppliesTo", "supplier", "s_suppkey", "Supplier", "key", "s_nationkey", "Customer", "nation"),
        EdgeMapping("home", "livesIn", "customer", "c_custkey", "Customer", "key", "c_nationkey", "Nation", "key", inverse="homeOf"),
    ]
    return ns, es, tabs


@query("""SELECT 'supplier_' || s_suppkey AS id, 'Supplier' AS node_type, s_name AS name, NULL AS label, 3 AS n_props FROM supplier
UNION ALL SELECT 'customer_' || c_custkey, 'Customer', c_name, NULL, 3 FROM customer
UNION ALL SELECT 'nation_' || n_nationkey, 'Nation', n_name, r_name, CASE WHEN r_name IS NULL THEN 2 ELSE 3 END FROM nation LEFT JOIN region ON r_regionkey = n_nationkey""")
def node_population(s, d):
    ns, _, tabs = _trade_mappings(s, d)
    one = lambda p: F.try_element_at(F.col("props")[p], F.lit(1)).alias(p)
    return build.build_nodes(tabs, ns).select("id", "node_type", one("name"), one("label"), F.size("props").alias("n_props"))


@query("SELECT 'livesIn' AS rel_type, 'customer_' || c_custkey AS start_id, 'nation_' || c_nationkey AS end_id FROM customer UNION ALL SELECT 'homeOf', 'nation_' || c_nationkey, 'customer_' || c_custkey FROM customer")
def relationship_population(s, d):
    ns, es, tabs = _trade_mappings(s, d)
    return build.build_edges(tabs, es[1:], build.build_nodes(tabs, ns)).select("rel_type", "start_id", "end_id")


_TRADE_EDGES = """e AS (SELECT 'placed' AS rel_type, 'customer_' || o_custkey AS start_id, 'order_' || o_orderkey AS end_id FROM orders
  UNION ALL SELECT 'contains', 'order_' || l_orderkey, 'part_' || l_partkey FROM lineitem UNION ALL SELECT 'suppliedBy', 'part_' || l_partkey, 'supplier_' || l_suppkey FROM lineitem
  UNION ALL SELECT 'inNation', 'customer_' || c_custkey, 'nation_' || c_nationkey FROM customer UNION ALL SELECT 'inRegion', 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation),
v AS (SELECT 'customer_' || c_custkey AS id, 'customer' AS node_type FROM customer UNION ALL SELECT 'order_' || o_orderkey, 'order' FROM orders UNION ALL SELECT 'part_' || p_partkey, 'part' FROM part UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 'nation_' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'region_' || r_regionkey, 'region' FROM region),
deg AS (SELECT id, count(*) AS degree FROM (SELECT start_id AS id FROM e UNION ALL SELECT end_id FROM e) GROUP BY id)"""


def trade_edges(s, d):
    e = lambda t, r, a, ka, b, kb: table(s, d, t).select(F.lit(r).alias("rel_type"), F.concat(F.lit(f"{a}_"), ka).alias("start_id"), F.concat(F.lit(f"{b}_"), kb).alias("end_id"))
    return rows.bag_append(e("orders", "placed", "customer", "o_custkey", "order", "o_orderkey"), e("lineitem", "contains", "order", "l_orderkey", "part", "l_partkey"), e("lineitem", "suppliedBy", "part", "l_partkey", "supplier", "l_suppkey"), e("customer", "inNation", "customer", "c_custkey", "nation", "c_nationkey"), e("nation", "inRegion", "nation", "n_nationkey", "region", "n_regionkey"))


def trade_nodes(s, d):
    v = lambda t, k, name: table(s, d, t).select(F.concat(F.lit(f"{name}_"), k).alias("id"), F.lit(name).alias("node_type"))
    return rows.bag_append(v("customer", "c_custkey", "customer"), v("orders", "o_orderkey", "order"), v("part", "p_partkey", "part"), v("supplier", "s_suppkey", "supplier"), v("nation", "n_nationkey", "nation"), v("region", "r_regionkey", "region"))


@query(f"WITH {_TRADE_EDGES} SELECT id AS node, degree FROM deg")
def node_degrees(s, d):
    return algo.degrees(trade_edges(s, d))


@query(f"WITH {_TRADE_EDGES} SELECT node_type, round(avg(coalesce(degree, 0)), 6) AS mean_degree FROM v LEFT JOIN deg USING (id) GROUP BY node_type")
def degree_avg(s, d):
    return algo.mean_degree(trade_nodes(s, d), trade_edges(s, d)).select("node_type", F.round("mean_degree", 6).alias("mean_degree"))


#: graph_nodes and graph_edges as they are: repeated and isolated nodes, blank and dangling ends.
_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT start_id AS id FROM graph_edges UNION ALL SELECT end_id FROM graph_edges) WHERE id IS NOT NULL GROUP BY id)"


@query(f"WITH {_DEG} SELECT node_type, count(*) AS n_nodes, count(*) FILTER (degree IS NULL) AS n_orphans, round(avg((degree IS NULL)::INT), 6) AS orphan_rate FROM graph_nodes LEFT JOIN deg USING (id) GROUP BY node_type")
def orphan_rate(s, d):
    return gm.orphan_rate(table(s, d, "graph_nodes"), table(s, d, "graph_edges")).withColumn("orphan_rate", F.round("orphan_rate", 6))


@query(f"WITH {_TRADE_EDGES} SELECT sum(n)::BIGINT AS n_rows, (sum(n) - count(*))::BIGINT AS n_duplicates, round((sum(n) - count(*)) / sum(n), 6) AS duplicate_rate FROM (SELECT count(*) AS n FROM e GROUP BY rel_type, start_id, end_id)")
def dup_edge_rate(s, d):
    return gm.duplicates(trade_edges(s, d), ["rel_type", "start_id", "end_id"]).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query("""WITH deg AS (SELECT rel_type, id, count(*) AS degree FROM (SELECT rel_type, start_id AS id FROM graph_edges UNION ALL SELECT rel_type, end_id FROM graph_edges) WHERE id IS NOT NULL GROUP BY ALL), q AS (SELECT rel_type, quantile_cont(degree, 0.99) AS p99 FROM deg GROUP BY rel_type)
SELECT rel_type, round(p99, 6) AS p99, count(*) FILTER (degree > p99) AS n_above FROM deg JOIN q USING (rel_type) GROUP BY ALL""")
def degree_outliers(s, d):
    return gm.degree_outliers(table(s, d, "graph_edges")).withColumn("p99", F.round("p99", 6))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT start_id AS a, end_id AS b FROM graph_edges WHERE start_id IS NOT NULL AND end_id IS NOT NULL UNION SELECT end_id, start_id FROM graph_edges WHERE start_id IS NOT NULL AND end_id IS NOT NULL UNION SELECT id, id FROM graph_nodes WHERE id IS NOT NULL),
cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a AS id, a AS comp FROM l UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.cc AS u, l, cc AS v WHERE l.a = u.id AND l.b = v.id AND v.comp < u.comp ORDER BY u.id, v.comp)),
g AS (SELECT comp, count(*) AS n FROM cc GROUP BY comp) SELECT sum(n)::BIGINT AS n_nodes, count(*) AS n_components, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_fraction FROM g""")
def components(s, d):
    return algo.component_summary(table(s, d, "graph_nodes"), table(s, d, "graph_edges")).withColumn("largest_fraction", F.round("largest_fraction", 6))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'region_' || n_regionkey AS src, 'nation_' || n_nationkey AS dst FROM nation UNION SELECT 'nation_' || c_nationkey, 'customer_' || c_custkey FROM customer UNION SELECT 'customer_' || o_custkey, 'order_' || o_orderkey FROM orders),
r AS (SELECT 'region_0' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def bfs_depth(s, d):
    e = lambda t, a, ka, b, kb: table(s, d, t).select(F.concat(F.lit(a), ka).alias("src"), F.concat(F.lit(b), kb).alias("dst"))
    return algo.bfs_depth(e("nation", "region_", "n_regionkey", "nation_", "n_nationkey").union(e("customer", "nation_", "c_nationkey", "customer_", "c_custkey")).union(e("orders", "customer_", "o_custkey", "order_", "o_orderkey")), "region_0")


_HP = "t AS (SELECT DISTINCT hp_id AS child, 'HP:' || unnest(regexp_extract_all(is_a, '(?i)HP[:_]([0-9]{7})', 1)) AS parent FROM phenotype_nodes WHERE hp_id IS NOT NULL), cl AS (SELECT child, parent AS ancestor FROM t UNION SELECT cl.child, t.parent FROM cl JOIN t ON t.child = cl.ancestor)"


@query(f"WITH RECURSIVE {_HP} SELECT child, ancestor FROM cl")
def closure(s, d):
    t = table(s, d, "phenotype_nodes")
    up = F.regexp_extract_all("is_a", F.lit("(?i)HP[:_]([0-9]{7})"), F.lit(1))
    return algo.closure(t.select(F.col("hp_id").alias("child"), F.explode(F.transform(up, lambda x: F.concat(F.lit("HP:"), x))).alias("parent")))


#: A type's superclasses are the databases its nodes come from; a relation's domain is the first
#: database of the type its edges start at, its range the type they end at.
_DOMAINS = """cl AS (SELECT DISTINCT node_type AS child, source_database AS ancestor FROM graph_nodes WHERE source_database IS NOT NULL), v AS (SELECT id, max(node_type) AS t FROM graph_nodes GROUP BY id),
typed AS (SELECT rel_type, start_id, end_id, a.t AS ts, b.t AS te FROM graph_edges LEFT JOIN v a ON a.id = start_id LEFT JOIN v b ON b.id = end_id),
ends AS (SELECT rel_type, arg_min(ts, (start_id, end_id)) FILTER (ts IS NOT NULL) AS start_type, arg_min(te, (start_id, end_id)) FILTER (te IS NOT NULL) AS end_type FROM typed GROUP BY rel_type),
dr AS (SELECT rel_type, min(ancestor) AS domain, end_type AS "range" FROM ends JOIN cl ON child = start_type WHERE end_type IS NOT NULL GROUP BY rel_type, end_type)"""


@query(f"""WITH {_DOMAINS} SELECT rel_type, sum((ts IS NOT NULL AND ts <> domain AND (ts, domain) NOT IN (SELECT (child, ancestor) FROM cl))::INT + (te IS NOT NULL AND te <> "range" AND (te, "range") NOT IN (SELECT (child, ancestor) FROM cl))::INT)::BIGINT AS violations FROM typed JOIN dr USING (rel_type) GROUP BY rel_type""")
def domain_range_violations(s, d):
    nodes, edges = table(s, d, "graph_nodes"), table(s, d, "graph_edges")
    up = nodes.select(F.col("node_type").alias("child"), F.col("source_database").alias("parent")).distinct()
    cl = algo.closure(up)
    ends = build.relation_ends(edges, nodes)
    dr = ends.join(cl, F.col("child") == F.col("start_type")).groupBy("rel_type", F.col("end_type").alias("range")).agg(F.min("ancestor").alias("domain"))
    return catalog.violations(edges, nodes, dr, cl)


@query(f"WITH {_DOMAINS} SELECT rel_type, start_type, end_type FROM ends WHERE start_type IS NOT NULL AND end_type IS NOT NULL")
def relation_ends(s, d):
    return build.relation_ends(table(s, d, "graph_edges"), table(s, d, "graph_nodes"))


@query("SELECT rel_type, count(*) AS n FROM graph_edges WHERE start_id IN (SELECT id FROM graph_nodes) AND end_id IN (SELECT id FROM graph_nodes) GROUP BY rel_type")
def endpoint_filter(s, d):
    return gm.edge_counts(build.valid_edges(table(s, d, "graph_edges"), table(s, d, "graph_nodes")))


def graph_triples(s, d):
    """graph_nodes and graph_edges as triples, the shape of a loaded ontology."""
    base = "http://ex.org/kg#"
    # Each kind of node has a namespace of its own.
    iri = lambda c: F.concat(F.lit("http://ex.org/"), F.substring_index(c, "_", 1), F.lit("#"), c)
    v, e = table(s, d, "graph_nodes"), table(s, d, "graph_edges")
    kinds = v.select(iri("id").alias("s"), F.lit(build.RDF + "type").alias("p"), F.explode(F.array(F.lit(build.OWL + "NamedIndividual"), F.concat(F.lit(base), "node_type"))).alias("o"), F.lit(False).alias("o_is_literal"))
    lits = v.select(iri("id").alias("s"), F.lit(base + "source").alias("p"), F.col("source_key").alias("o"), F.lit(True).alias("o_is_literal")).where("o is not null")
    rels = e.where(~x.is_blank("start_id") & ~x.is_blank("end_id")).select(iri("start_id").alias("s"), F.concat(F.lit(base), "rel_type").alias("p"), iri("end_id").alias("o"), F.lit(False).alias("o_is_literal"))
    return kinds.unionByName(lits).unionByName(rels)


@query("SELECT node_type, count(*) AS n, sum(k)::BIGINT AS n_values FROM (SELECT id, node_type, count(DISTINCT source_key) AS k FROM (SELECT a.id, a.node_type, b.source_key FROM graph_nodes a JOIN graph_nodes b USING (id)) GROUP BY id, node_type) GROUP BY node_type")
def triple_nodes(s, d):
    t = build.triple_nodes(graph_triples(s, d))
    return t.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size(F.col("props")["source"]), F.lit(0))).alias("n_values"))


@query("SELECT rel_type, count(*) AS n FROM graph_edges WHERE start_id IN (SELECT id FROM graph_nodes) AND end_id IN (SELECT id FROM graph_nodes) GROUP BY rel_type")
def triple_edges(s, d):
    return gm.edge_counts(build.triple_edges(graph_triples(s, d)))


@query("SELECT arg_min(ns, (-n, ns)) AS namespace FROM (SELECT 'http://ex.org/' || split_part(id, '_', 1) || '#' AS ns, count(DISTINCT id) AS n FROM graph_nodes GROUP BY 1)")
def namespace_detection(s, d):
    return build.main_namespace(graph_triples(s, d))


@query(f"""WITH {_DOMAINS}, ep AS (SELECT rel_type, string_agg(DISTINCT '`' || k || '`: row.`' || k || '`', ', ' ORDER BY '`' || k || '`: row.`' || k || '`') AS f FROM (SELECT rel_type, unnest(map_keys(props)) AS k FROM graph_edges) GROUP BY rel_type),
types AS (SELECT DISTINCT node_type AS t FROM graph_nodes), part AS (
  SELECT 0 AS sec, '' AS k, '// indexes' AS line UNION ALL SELECT 1, t, 'CREATE INDEX ON :`' || t || '`(id);' FROM types UNION ALL SELECT 2, '', '' UNION ALL SELECT 3, '', '// nodes'
  UNION ALL SELECT 4, t, 'LOAD CSV FROM "./nodes_' || t || '.csv" WITH HEADER AS row CREATE (:`' || t || '` {{`id`: row.`id`, `database`: row.`database`, `source`: row.`source`}});' FROM types
  UNION ALL SELECT 5, '', '' UNION ALL SELECT 6, '', '// edges'
  UNION ALL SELECT 7, rel_type, 'LOAD CSV FROM "./edges_' || rel_type || '.csv" WITH HEADER AS row MATCH (a:`' || start_type || '` {{id: row.start_id}}), (b:`' || end_type || '` {{id: row.end_id}}) CREATE (a)-[:`' || rel_type || '`' || coalesce(' {{' || f || '}}', '') || ']->(b);' FROM ends LEFT JOIN ep USING (rel_type) WHERE start_type IS NOT NULL AND end_type IS NOT NULL)
SELECT (row_number() OVER (ORDER BY sec, k) - 1)::INTEGER AS line_no, line FROM part""")
def cypher_script(s, d):
    """The script that imports graph_nodes and graph_edges, all types and relations."""
    v, e = table(s, d, "graph_nodes"), table(s, d, "graph_edges")
    nodes = v.select("id", "node_type", F.create_map(F.lit("source"), F.array("source_key"), F.lit("database"), F.array("source_database")).alias("props"))
    lines = export.cypher_script(export.property_names(nodes), export.relation_properties(e, build.relation_ends(e, v))).splitlines()
    return s.createDataFrame(list(enumerate(lines)), "line_no int, line string")


# Metrics

@query("SELECT column_name, round(avg(CASE WHEN v IS NULL OR regexp_full_match(v, '\\s*') THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM (SELECT 'umls_cui' AS column_name, umls_cui AS v FROM disease_nodes UNION ALL SELECT 'definition', definition FROM disease_nodes UNION ALL SELECT 'omim_id', omim_id FROM disease_nodes) GROUP BY column_name")
def null_rate(s, d):
    return tm.null_rates(table(s, d, "disease_nodes"), ["umls_cui", "definition", "omim_id"]).select("column_name", F.round("null_rate", 6).alias("null_rate"))


@query("SELECT column_name, count(*) AS n_values, round(avg(ok::INT), 6) AS validity_rate FROM (SELECT 'umls_cui' AS column_name, umls_cui AS v, regexp_full_match(trim(umls_cui, E' \\t\\n\\r'), 'C\\d{7}') AS ok FROM disease_nodes UNION ALL SELECT 'omim_id', omim_id, regexp_full_match(trim(omim_id, E' \\t\\n\\r'), '\\d+(\\.\\d+)?') FROM disease_nodes) WHERE v IS NOT NULL AND NOT regexp_full_match(v, '\\s*') GROUP BY column_name")
def id_validity(s, d):
    return tm.identifier_validity(table(s, d, "disease_nodes"), {"umls_cui": "xrefUmlsCUI", "omim_id": "xrefOMIM"}).withColumn("validity_rate", F.round("validity_rate", 6))


@query("SELECT column_name, count(*) AS n_values, count(*) FILTER (NOT ok) AS n_violations FROM (SELECT column_name, regexp_full_match(trim(v, E' \\t\\n\\r'), '-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?') AS ok FROM (SELECT 'doid' AS column_name, doid AS v FROM disease_nodes UNION ALL SELECT 'orpha_id', orpha_id FROM disease_nodes UNION ALL SELECT 'snomed_id', snomed_id FROM disease_nodes UNION ALL SELECT 'mesh_id', mesh_id FROM disease_nodes) WHERE v IS NOT NULL AND NOT regexp_full_match(v, '\\s*')) GROUP BY column_name HAVING avg(ok::INT) > 0.9")
def numeric_violations(s, d):
    return tm.numeric_violations(table(s, d, "disease_nodes"), ["doid", "orpha_id", "snomed_id", "mesh_id"])


@query("SELECT sum(n)::BIGINT AS n_keys, (sum(n) - count(*))::BIGINT AS n_duplicates, round((sum(n) - count(*)) / sum(n), 6) AS duplication_rate FROM (SELECT count(*) AS n FROM disease_nodes WHERE trim(mondo_id) <> '' GROUP BY trim(mondo_id))")
def dup_rate(s, d):
    return tm.duplication(table(s, d, "disease_nodes"), "mondo_id").withColumn("duplication_rate", F.round("duplication_rate", 6))


@query("SELECT round(avg(coalesce((OrganismID = '9606')::INT, 0)), 6) AS pass_rate FROM ctd_interactions")
def filter_pass_rate(s, d):
    return tm.filter_pass_rate(table(s, d, "ctd_interactions"), "OrganismID", "9606").withColumn("pass_rate", F.round("pass_rate", 6))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) > 0 AS extracted FROM {t}" for t in ("genes", "disease_nodes", "graph_edges")))
def record_counts(s, d):
    return tm.record_counts({t: table(s, d, t) for t in ("genes", "disease_nodes", "graph_edges")})


@query("""WITH r AS (SELECT trim(coalesce(start_id, ''), E' \\t\\n\\r') AS a, trim(coalesce(end_id, ''), E' \\t\\n\\r') AS b FROM graph_edges WHERE source_database = 'CTD'), v AS (SELECT DISTINCT trim(id) AS id FROM graph_nodes WHERE trim(id) <> '')
SELECT count(*) AS n_rows, count(*) FILTER (x.id IS NOT NULL AND y.id IS NOT NULL) AS n_resolved, round(avg((x.id IS NOT NULL AND y.id IS NOT NULL)::INT), 6) AS resolution_rate FROM r LEFT JOIN v x ON x.id = a LEFT JOIN v y ON y.id = b""")
def resolution_rate(s, d):
    """All edges of one source, blank and dangling ends among them."""
    v = table(s, d, "graph_nodes").select("id")
    return gm.resolution_rate(table(s, d, "graph_edges"), "start_id", "end_id", v, v, "source_database", "CTD").withColumn("resolution_rate", F.round("resolution_rate", 6))


@query("WITH k AS (SELECT trim(umls_cui, E' \\t\\n\\r') AS k FROM disease_nodes WHERE load_no > 4), b AS (SELECT DISTINCT trim(umls_cui, E' \\t\\n\\r') AS k FROM disease_nodes WHERE load_no <= 4) SELECT count(*) AS n_eligible, round(avg((k IN (SELECT k FROM b WHERE k IS NOT NULL))::INT), 6) AS match_rate FROM k WHERE k <> ''")
def merge_match_rate(s, d):
    """The identifiers of the later loads that the earlier ones have."""
    t = table(s, d, "disease_nodes")
    return gm.match_rate(t.where("load_no > 4"), "umls_cui", t.where("load_no <= 4").select("umls_cui")).withColumn("match_rate", F.round("match_rate", 6))


_DELTA = "a AS (SELECT type_of_gene, count(*) AS n FROM genes GROUP BY 1), b AS (SELECT type_of_gene, count(*) AS n FROM genes WHERE load_no <= 4 GROUP BY 1), delta AS (SELECT a.type_of_gene, a.n, coalesce(b.n, 0) AS n_before, a.n - coalesce(b.n, 0) AS delta FROM a LEFT JOIN b ON a.type_of_gene IS NOT DISTINCT FROM b.type_of_gene)"


@query(f"WITH {_DELTA} SELECT * FROM delta")
def count_delta(s, d):
    """The table now against the table as it was after its fourth load."""
    g = table(s, d, "genes")
    c = lambda df: df.groupBy("type_of_gene").agg(F.count(F.lit(1)).alias("n"))
    return gm.count_deltas(c(g), c(g.where("load_no <= 4")), "type_of_gene")


@query(f"WITH {_DELTA} SELECT count(*) FILTER (delta <> 0) AS n_changed, coalesce(max(abs(delta)), 0)::BIGINT AS max_abs_delta FROM delta")
def largest_delta(s, d):
    return gm.largest_delta(count_delta(s, d))


_EXPECTED = {"genes": ["GeneID", "Symbol", "map_location"], "chemical_nodes": ["chemical_id", "inchikey"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, coalesce(string_agg(p, '|' ORDER BY p) FILTER (p NOT IN (SELECT column_name FROM (DESCRIBE {t}))), '') AS missing, round(avg((p IN (SELECT column_name FROM (DESCRIBE {t})))::INT), 6) AS completeness FROM (VALUES {', '.join(f'(' + chr(39) + p + chr(39) + ')' for p in ps)}) x(p)" for t, ps in _EXPECTED.items()))
def property_completeness(s, d):
    found = {t: table(s, d, t).columns for t in _EXPECTED}
    return s.createDataFrame([(t, "|".join(m), round(c, 6)) for t, m, c in gm.property_completeness(_EXPECTED, found)], "table_name string, missing string, completeness double")


_REFS = "refs AS (SELECT DISTINCT id, v AS value FROM (SELECT mondo_id AS id, unnest([" + ", ".join(f"trim({c}, E' \\t\\n\\r')" for c in ("umls_cui", "omim_id", "doid", "mesh_id")) + "]) AS v FROM disease_nodes) WHERE v <> '' AND id IS NOT NULL), g AS (SELECT value, count(*) AS n FROM refs GROUP BY value)"


def _disease_references(s, d):
    return gm.references(table(s, d, "disease_nodes"), ["umls_cui", "omim_id", "doid", "mesh_id"], "mondo_id")


@query(f"WITH {_REFS} SELECT count(*) AS n_values, coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS n_pairs FROM g WHERE n > 1")
def shared_reference_pairs(s, d):
    return gm.shared_reference_pairs(_disease_references(s, d))


@query(f"WITH {_REFS} SELECT sum(n)::BIGINT AS n_entries, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_resolved, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS resolution_rate FROM g")
def reference_resolution(s, d):
    return gm.reference_resolution(_disease_references(s, d)).withColumn("resolution_rate", F.round("resolution_rate", 6))


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_repeated FROM (SELECT count(*) AS n FROM graph_nodes WHERE id IS NOT NULL GROUP BY node_type, id)")
def repeated_ids(s, d):
    return gm.repeated_ids(table(s, d, "graph_nodes"))


@query(f"WITH {_REFS} SELECT value, string_agg(id, '|' ORDER BY id) AS ids FROM refs GROUP BY value")
def nodes_per_value(s, d):
    return gm.nodes_per_value(_disease_references(s, d)).select("value", F.array_join("ids", "|").alias("ids"))


@query("SELECT 'node' AS kind, count(DISTINCT node_type) AS n_types, string_agg(DISTINCT node_type, '|' ORDER BY node_type) AS types FROM graph_nodes UNION ALL SELECT 'edge', count(DISTINCT rel_type), string_agg(DISTINCT rel_type, '|' ORDER BY rel_type) FROM graph_edges")
def populated_types(s, d):
    return gm.populated_types(table(s, d, "graph_nodes"), table(s, d, "graph_edges")).withColumn("types", F.array_join("types", "|"))


@query("WITH p AS (SELECT DISTINCT lower(trim(source)) AS s FROM documents WHERE source IS NOT NULL), w AS (SELECT source AS s FROM source_weights), b AS (SELECT count(*) AS n FROM p JOIN w USING (s)) SELECT (SELECT count(*) FROM p) AS n_part, (SELECT count(*) FROM w) AS n_whole, n AS n_both, round(n / (SELECT count(*) FROM w), 6) AS activation, round(n / (SELECT count(*) FROM p), 6) AS conformance FROM b")
def activation_rates(s, d):
    p = table(s, d, "documents").where("source is not null").select(F.lower(F.trim("source")).alias("source"))
    r = gm.set_rate(p, table(s, d, "source_weights"), "source")
    return r.withColumn("activation", F.round("activation", 6)).withColumn("conformance", F.round("conformance", 6))


@query("SELECT count(*) AS n, count(*) FILTER (b) AS n_covered, round(avg(b::INT), 6) AS coverage FROM (SELECT DISTINCT GeneID, GeneID IN (SELECT GeneID FROM ctd_interactions WHERE GeneID IS NOT NULL) AS b FROM genes WHERE trim(GeneID) <> '')")
def target_coverage(s, d):
    return gm.coverage(table(s, d, "genes"), table(s, d, "ctd_interactions"), "GeneID").withColumn("coverage", F.round("coverage", 6))


@query("WITH k AS (SELECT DISTINCT start_id, end_id FROM graph_edges WHERE source_database = 'DisGeNET' AND trim(start_id) <> '' AND trim(end_id) <> ''), f AS (SELECT DISTINCT start_id, end_id FROM graph_edges WHERE asserted_at < TIMESTAMP '2023-05-01') SELECT count(*) AS n_known, count(f.start_id) AS n_found, round(count(f.start_id) / count(*), 6) AS recall FROM k LEFT JOIN f USING (start_id, end_id)")
def known_recall(s, d):
    e = table(s, d, "graph_edges")
    k = e.where("source_database = 'DisGeNET' and trim(start_id) <> '' and trim(end_id) <> ''").select("start_id", "end_id")
    return gm.recall(k, e.where("asserted_at < timestamp '2023-05-01'")).withColumn("recall", F.round("recall", 6))


# Logs

@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) WHERE a = 1 OR b <= 4")
def truncate_messages(s, d):
    return logs.truncate_messages(table(s, d, "events").select("user_id", "event_id"), 5, "user_id", "event_id")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase')")
def event_filter(s, d):
    return logs.filter_events(table(s, d, "events"), ["click", "purchase"]).select("event_id", "event_type", "value")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def telemetry_tail(s, d):
    return logs.tail(table(s, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


@query("SELECT user_id, event_id, round(sum(coalesce(value, 0)) OVER w, 4) AS running_total, sum(coalesce(value, 0)) OVER w > 300 AS over_budget FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_budget(s, d):
    return logs.running_budget(table(s, d, "events"), "user_id", "event_id", "value", 300.0).select("user_id", "event_id", F.round("running_total", 4).alias("running_total"), "over_budget")


def _streamed(s, stream, mode: str, name: str):
    """What a stream has written when all there is has been read, batch by batch."""
    at, state = scratch_path(s, name), scratch_path(s, f"{name}-state")
    keep = "append" if mode == "append" else "overwrite"
    write = lambda batch, _: batch.write.mode(keep).parquet(at)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(at)


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'view')")
def stream_filter(s, d):
    e = logs.filter_events(logs.event_stream(s, f"{d}/events*.parquet"), ["error", "view"])
    return _streamed(s, e.select("event_id", "event_type", "value"), "append", "stream-filter")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL")
def stream_usage(s, d):
    w = _streamed(s, logs.windowed_usage(logs.event_stream(s, f"{d}/events*.parquet"), ["click", "purchase"]), "complete", "stream-usage")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH f AS (SELECT user_id, event_id, (value > 50)::INT AS f FROM events), i AS (SELECT *, sum(1 - coalesce(f, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM f) SELECT user_id, event_id, sum(coalesce(f, 0)) OVER (PARTITION BY user_id, i ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS consecutive_failures FROM i")
def failure_streaks(s, d):
    return logs.failure_streaks(table(s, d, "events"), "user_id", "event_id", F.col("value") > 50).select("user_id", "event_id", "consecutive_failures")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY ALL")
def windowed_usage(s, d):
    w = logs.windowed_usage(table(s, d, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


#: Responses with tags in every state: closed, left open, named inside think blocks, missing.
_TAGGED = [("with", "<think>"), ("from", "</think>"), ("the", "<execute>"), ("after", "</execute>"), ("was", "<solution>"), ("and", "</solution>"), ("in", "<observation>"), ("for", "</observation>")]


def _tagged(c):
    for word, tag in _TAGGED:
        c = F.replace(c, F.lit(f" {word} "), F.lit(f" {tag} "))
    return c


_TAGS = "text"
for _word, _tag in _TAGGED:
    _TAGS = f"replace({_TAGS}, ' {_word} ', ' {_tag} ')"
_WS = "E' \\t\\n\\r\\f\\x0b'"
_ENDED = f"""a AS (SELECT doc_id, {_TAGS} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, t, regexp_replace(t, '(?s)<think>.*?</think>', '', 'g') AS o FROM a),
c AS (SELECT doc_id, t, o, contains(o, '<execute>') AND NOT contains(o, '</execute>') AS ne FROM b), e AS (SELECT doc_id, t || CASE WHEN ne THEN '</execute>' ELSE '' END AS t, o || CASE WHEN ne THEN '</execute>' ELSE '' END AS o FROM c),
f AS (SELECT doc_id, t, o, contains(o, '<solution>') AND NOT contains(o, '</solution>') AS ns FROM e), g AS (SELECT doc_id, t || CASE WHEN ns THEN '</solution>' ELSE '' END AS t, o || CASE WHEN ns THEN '</solution>' ELSE '' END AS o FROM f),
h AS (SELECT doc_id, t || CASE WHEN contains(t, '<think>') AND NOT contains(t, '</think>') THEN '</think>' ELSE '' END AS t, o FROM g)"""


@query(f"""WITH {_ENDED} SELECT doc_id, md5(regexp_replace(regexp_replace(t, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '')) AS repaired,
CASE WHEN regexp_matches(o, '(?s)<solution>.*?</solution>') THEN 'end' WHEN regexp_matches(o, '(?s)<execute>.*?</execute>') THEN 'execute' ELSE 'generate' END AS step FROM h""")
def tag_dispatch(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", _tagged(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(logs.repair_tags("t")).alias("repaired"), logs.next_step("t").alias("step"))


@query(f"""WITH a AS (SELECT doc_id, {_TAGS} AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, t, regexp_extract(t, '(?s)<solution>(.*?)</solution>', 1) AS sol, regexp_matches(t, '(?s)<solution>.*?</solution>') AS has, regexp_replace(t, '(?s)<(?:think|execute|observation)>.*?</(?:think|execute|observation)>', '', 'g') AS rest FROM a),
c AS (SELECT doc_id, CASE WHEN has THEN sol WHEN regexp_replace(rest, '[\\s\\x{{a0}}]+', '', 'g') <> '' THEN rest ELSE t END AS x FROM b)
SELECT doc_id, md5(left(regexp_replace(regexp_replace(x, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', ''), 2000)) AS answer FROM c""")
def solutions(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", _tagged(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(logs.solution("t")).alias("answer"))


_CODE = ["#!R plot(1)", "# R code x", "# R script y", "# R notes", "#!BASH ls", "# Bash script ls", "# Bashing numbers", "#!CLI ls", "print(1)", " #!R late"]
_MARKS = ["#!R", "# R code", "# R script", "#!BASH", "# Bash script", "#!CLI"]


@query(f"""WITH t AS (SELECT event_id, (list_value({', '.join(f"'{c}'" for c in _CODE)}))[event_id % {len(_CODE)} + 1] || event_id AS c FROM events)
SELECT event_id, CASE {' '.join(f"WHEN starts_with(c, '{m}') THEN '{'r' if ' R' in m or '!R' in m else 'bash'}'" for m in _MARKS)} ELSE 'python' END AS language, CASE WHEN regexp_matches(c, '^({'|'.join(_MARKS)})') THEN trim(regexp_replace(c, '^({'|'.join(_MARKS)})', '')) ELSE c END AS code FROM t""")
def code_languages(s, d):
    c = F.concat(F.element_at(F.array(*map(F.lit, _CODE)), (F.pmod("event_id", F.lit(len(_CODE))) + 1).cast("int")), F.col("event_id").cast("string"))
    t = table(s, d, "events").select("event_id", c.alias("c"))
    return t.select("event_id", logs.code_language("c").alias("language"), logs.without_marker("c").alias("code"))


@query("""WITH f AS (SELECT user_id, event_id, coalesce((value > 50)::INT, 0) AS f, row_number() OVER w AS n, coalesce(sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, lag(f, 1, 0) OVER w AS f1, lag(f, 2, 0) OVER w AS f2 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN n > 150 THEN 'max_iterations' WHEN spent >= 4000.005 THEN 'max_cost' WHEN f1 + f2 = 2 THEN 'max_failures' END AS ended_by FROM g""")
def run_ends(s, d):
    return logs.run_ends(table(s, d, "events"), "user_id", "event_id", "value", F.col("value") > 50, 150, 4000.005, 2).select("user_id", "event_id", "ended_by")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS result FROM (SELECT user_id, event_type, event_id, value FROM events) GROUP BY ALL")
def last_results(s, d):
    return logs.last_results(table(s, d, "events"), "user_id", "event_type", "event_id", "value").withColumnRenamed("value", "result")


# Articles

_MED = """doc AS (SELECT DISTINCT pmid AS doc, regexp_replace(upper(trim(mesh_id)), '^MESH:', '') AS m, entity_kind FROM pmid_mesh WHERE mesh_id IS NOT NULL AND pmid IS NOT NULL), src AS (SELECT doc, m FROM doc WHERE entity_kind = 'symptom'), tgt AS (SELECT doc, m FROM doc WHERE entity_kind = 'anatomy'),
corp AS (SELECT count(*) AS corpus FROM (SELECT DISTINCT doc FROM src INTERSECT SELECT DISTINCT doc FROM tgt)), ns AS (SELECT m, count(*) AS n FROM src GROUP BY m), nt AS (SELECT m, count(*) AS n FROM tgt GROUP BY m),
pr AS (SELECT s.m AS source_id, t.m AS target_id, count(*) AS a FROM src s JOIN tgt t USING (doc) GROUP BY ALL)"""


@query(f"WITH {_MED} SELECT source_id, target_id, a AS cooccurrence, round(a * corpus / (x.n * y.n), 4) AS enrichment FROM pr JOIN ns x ON x.m = source_id JOIN nt y ON y.m = target_id, corp")
def article_cooccurrence(s, d):
    t = table(s, d, "pmid_mesh").where("mesh_id is not null").select(F.col("pmid").alias("doc"), F.regexp_replace(F.upper(F.trim("mesh_id")), "^MESH:", "").alias("m"), "entity_kind")
    a, b = t.where("entity_kind = 'symptom'").select(F.col("m").alias("source_id"), "doc"), t.where("entity_kind = 'anatomy'").select(F.col("m").alias("target_id"), "doc")
    return enrichment.pair_statistics(a, b, enrichment.corpus_size(a, b)).select("source_id", "target_id", "cooccurrence", "enrichment")


# Registries, index lists, embedded graphs

def _registry(s, d):
    """Parts as resources: every third is a tool, the others data or libraries."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("tool"), F.lit("data"), F.lit("library")), (k % 3 + 1).cast("int"))
    return table(s, d, "part").select(k.alias("id"), kind.alias("kind"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), F.concat(F.lit("pkg."), F.lower("p_type")).alias("module"), F.col("p_brand").alias("category"), F.when(k % 2 == 0, "CSV").otherwise("json").alias("format"))


@query("SELECT p_name || ' ' || p_partkey AS name FROM part WHERE contains('pkg.' || lower(p_type), 'pkg.eco') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#17') AND p_brand = 'Brand#17' AND p_partkey % 2 = 0")
def registry_filter(s, d):
    r = _registry(s, d)
    names = [x.name for x in r.where("category in ('Brand#1', 'Brand#2', 'Brand#17')").select("name").collect()]  # a choice of names, as a user gives them
    return logs.catalog_filter(r, module="pkg.eco", category="Brand#17", fmt="csv", names=names).select("name")


@query("SELECT kind, count(*) AS n, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS categories FROM (SELECT (['tool', 'data', 'library'])[p_partkey % 3 + 1] AS kind, p_brand FROM part) GROUP BY kind")
def registry_counts(s, d):
    return logs.catalog_counts(_registry(s, d)).withColumn("categories", F.array_join("categories", "|"))


@query("WITH r AS (SELECT (['tool', 'data', 'library'])[p_partkey % 3 + 1] AS kind, p_name || ' ' || p_partkey AS name, p_brand AS category FROM part) SELECT kind, name, category, CASE WHEN kind = 'tool' THEN (row_number() OVER (PARTITION BY kind ORDER BY name) - 1)::INTEGER END AS id FROM r")
def registry_json(s, d):
    """Written as JSON without ids and read back: tools are numbered anew."""
    at = scratch_path(s, "registry")
    logs.write_registry(_registry(s, d), at)
    return logs.read_registry(s, at, "kind string, name string, category string").select("kind", "name", "category", "id")


@query("WITH r AS (SELECT o_orderkey, unnest([o_custkey % 60, o_orderkey % 2100]) AS pos FROM orders) SELECT o_orderkey, p_name FROM r JOIN part ON p_partkey = pos")
def select_by_index(s, d):
    """Lists of positions in a text, malformed entries among them, and what stands there."""
    text = F.concat(F.lit("I would take\nTools: ["), (F.col("o_custkey") % 60).cast("string"), F.lit(", x, "), (F.col("o_orderkey") % 2100).cast("string"), F.lit(", 1.5] and DATA: [7]"))
    r = table(s, d, "orders").select("o_orderkey", logs.index_list(text, "TOOLS").alias("at"))
    return logs.select_by_index(r, table(s, d, "part").select(F.col("p_partkey").cast("int").alias("pos"), "p_name"), "at").select("o_orderkey", "p_name")


@query("SELECT event_id, 'n' || (event_id % 5) AS first_node, 2 AS n_nodes, 'n' || (event_id % 5) || '>m' AS link FROM events WHERE event_id % 3 <> 0")
def embedded_graphs(s, d):
    k = (F.col("event_id") % 5).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, "no graph {here}").otherwise(F.concat(F.lit('see {"nodes": [{"id": "n'), k, F.lit('", "label": "x"}, {"id": "m"}], "links": [{"source": "n'), k, F.lit('", "target": "m"}]} above')))
    g = table(s, d, "events").select("event_id", logs.embedded_graph(text).alias("g")).where("g.nodes is not null")
    return g.select("event_id", F.col("g.nodes")[0]["id"].alias("first_node"), F.size("g.nodes").alias("n_nodes"), F.concat(F.col("g.links")[0]["source"], F.lit(">"), F.col("g.links")[0]["target"]).alias("link"))


@query("WITH o AS (SELECT id, node_type FROM graph_nodes WHERE source_database = 'CTD'), n AS (SELECT id, max(node_type) AS node_type FROM graph_nodes WHERE source_database <> 'CTD' GROUP BY id), v AS (SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)) SELECT node_type, count(*) AS n, (SELECT count(*) FROM graph_edges WHERE source_database IN ('CTD', 'STRING')) AS n_links FROM v GROUP BY node_type")
def graph_merge(s, d):
    """New nodes by id beside the old ones, links appended as they come."""
    v, e = table(s, d, "graph_nodes").select("id", "node_type", "source_database"), table(s, d, "graph_edges").select("edge_id", "source_database")
    of = lambda df, x: df.where(F.col("source_database") == x)
    nodes, links = logs.merge_graph(of(v, "CTD"), v.where("source_database <> 'CTD'"), of(e, "CTD"), of(e, "STRING"))
    n = links.count()
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).withColumn("n_links", F.lit(n).cast("long"))


# More metrics

@query("SELECT DISTINCT gene, disease FROM (SELECT id AS gene, unnest(regexp_extract_all(p, '([0-9]{6})\\s*\\(3\\)', 1)) AS disease FROM (SELECT mondo_id AS id, coalesce(disease_name, '') || ', ' || coalesce(omim_id, '') || ' (' || (row_id % 4) || '); x, ' || coalesce(orpha_id, '') || '(3)' AS p FROM disease_nodes WHERE trim(mondo_id) <> ''))")
def known_pairs(s, d):
    t = table(s, d, "disease_nodes")
    text = F.concat(F.coalesce("disease_name", F.lit("")), F.lit(", "), F.coalesce("omim_id", F.lit("")), F.lit(" ("), (F.col("row_id") % 4).cast("string"), F.lit("); x, "), F.coalesce("orpha_id", F.lit("")), F.lit("(3)"))
    return gm.known_pairs(t.select(F.col("mondo_id").alias("gene"), text.alias("phenotypes")))


@query("SELECT node_type AS name, count(*) AS n FROM graph_nodes GROUP BY 1 UNION ALL SELECT rel_type, count(*) FROM graph_edges GROUP BY 1")
def type_counts(s, d):
    a, b = gm.node_counts(table(s, d, "graph_nodes")), gm.edge_counts(table(s, d, "graph_edges"))
    return a.withColumnRenamed("node_type", "name").unionByName(b.withColumnRenamed("rel_type", "name"))


@query("SELECT round(avg((o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)::INT), 6) AS rate FROM orders")
def direct_download_rate(s, d):
    k = F.col("o_orderkey")
    notes = F.when(k % 5 == 0, "from GitHub releases").when(k % 7 == 0, "github.com/x").when(k % 2 == 0, "an ftp server")
    return table(s, d, "orders").select(notes.alias("notes")).agg(F.round(tm.rate(tm.direct_download("notes")), 6).alias("rate"))


_DECLARED = {"genes": ["GeneID", "Symbol", "LocusTag"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "nowhere": ["x"]}


@query("SELECT 'genes' AS table_name, 'LocusTag' AS missing, (SELECT string_agg(column_name, '|' ORDER BY column_name) FROM (DESCRIBE genes) WHERE column_name NOT IN ('GeneID', 'Symbol', 'LocusTag')) AS additional UNION ALL SELECT 'nowhere', 'x', ''")
def schema_conformance(s, d):
    found = tm.schema_conformance(_DECLARED, {t: table(s, d, t) for t in ("genes", "part")})
    return s.createDataFrame([(t, "|".join(a), "|".join(b)) for t, a, b in found], "table_name string, missing string, additional string")


@query("SELECT kind, name, bool_or(declared) AS declared, bool_or(populated) AS populated FROM (SELECT 'class' AS kind, unnest(['Gene', 'Disease', 'Chemical', 'Drug', 'Thing']) AS name, true AS declared, false AS populated UNION ALL SELECT 'relation', unnest(['geneInteractsWithGene', 'treats']), true, false UNION ALL SELECT 'class', node_type, false, true FROM graph_nodes UNION ALL SELECT 'relation', rel_type, false, true FROM graph_edges) GROUP BY kind, name")
def catalog_listing(s, d):
    """Types that a catalog declares beside those that have data, after additions and a removal."""
    c = catalog.Catalog()
    c.add_class("Thing")
    for name in ("Gene", "Disease", "Chemical", "Drug", "Gone"):
        c.add_class(name, "Thing")
    c.add_object_property("geneInteractsWithGene", "Gene", "Gene")
    c.add_object_property("treats", "Drug", "Disease", "treatedBy")
    c.remove("Gone")
    return c.listing(s, table(s, d, "graph_nodes"), table(s, d, "graph_edges"))


@query(f"""SELECT row_id, coalesce(disease_name, 'NA') AS plain, split_part(split_part('http://x/y#' || mondo_id, '#', 2), ' ', 1) AS fragment, trim(split_part(coalesce(is_a, ''), ' !', 1), E' \\t\\n\\r') AS parent, CASE WHEN coalesce(disease_name, 'NA') = 'NA' THEN NULL ELSE disease_name END AS known,
coalesce(umls_cui, '-') || CASE WHEN coalesce(mesh_id, '-') <> coalesce(umls_cui, '-') THEN '|' || coalesce(mesh_id, '-') ELSE '' END AS ids FROM disease_nodes""")
def text_cleaning(s, d):
    t = table(s, d, "disease_nodes")
    name = F.coalesce("disease_name", F.lit("NA"))
    esc = F.concat(F.lit("\x1b[31m"), name, F.lit("\x1b[0m"))
    return t.select("row_id", x.without_ansi(esc).alias("plain"), x.first_token(x.local_fragment(F.concat(F.lit("http://x/y#"), "mondo_id"))).alias("fragment"), x.before(F.coalesce("is_a", F.lit("")), " !").alias("parent"), x.normalize_na(name).alias("known"), F.array_join(n.ordered_union(F.array(F.coalesce("umls_cui", F.lit("-"))), F.array(F.coalesce("mesh_id", F.lit("-"))), F.array(F.coalesce("umls_cui", F.lit("-")))), "|").alias("ids"))


@query("SELECT id, nullif(first(name), '') AS name, count(*) AS n FROM (SELECT 'gene_' || lower(trim(GeneID)) AS id, arg_min(coalesce(Symbol, ''), row_id) AS name FROM genes WHERE trim(GeneID) <> '' GROUP BY 1) GROUP BY id")
def unique_rows(s, d):
    """One node per id, made of its first row."""
    g = table(s, d, "genes").withColumn("_ord", F.col("row_id")).withColumn("Symbol", F.coalesce("Symbol", F.lit("")))
    m = NodeMapping("genes", "Gene", "genes", "GeneID", {"Symbol": "name"}, unique_rows=True)
    v = build.build_nodes({"genes": g}, [m])
    return v.select("id", F.try_element_at(F.col("props")["name"], F.lit(1)).alias("name"), F.coalesce(F.size(F.col("props")["name"]), F.lit(1)).cast("long").alias("n"))
