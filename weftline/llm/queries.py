"""The pN_ queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.llm import components, cooccurrence, leak, mixing, quality, tokens
from weftline.plans.tables import table
from weftline.storage import cut

#: What an identifier is, after its last colon; digits that are all zero are no identifier.
IDENTIFIERS = {"umls_cui": "C[0-9]{7}", "doid": "[0-9]{1,7}", "mesh_id": "[CD](?:[0-9]{6}|[0-9]{9})", "omim_id": "[0-9]{6}"}


def term_memberships(spark: SparkSession, d: str) -> DataFrame:
    """(node, key): a term and each identifier of its rows, marked with its field. Every
    term also holds its own id, so that terms without identifiers are there too."""
    t = table(spark, d, "disease_nodes")
    cells = []
    for c, pattern in IDENTIFIERS.items():
        v = F.upper(strip(F.element_at(F.split(F.col(c), ":"), -1)))
        cells.append(F.when(v.rlike(f"^{pattern}\\z") & v.rlike("[1-9]"), F.concat(F.lit(f"{c}="), v)))
    cells.append(F.concat(F.lit("term="), F.col("mondo_id")))
    return t.select(F.col("mondo_id").alias("node"), F.explode(F.array_compact(F.array(*cells))).alias("key"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every term and its group."""
    g = components.group_matches(components.star_pairs(term_memberships(spark, d)))
    return g.select(F.col("node").alias("mondo_id"), "group_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    g = cut(p2_groups(spark, d), "groups")
    # A group's smallest member is its id, so any other member makes it one of two or more.
    more = g.where("mondo_id <> group_id").select("group_id").distinct()
    return g.join(more, "group_id", "left_semi").select("mondo_id", "group_id")


def article_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(basket, item) of both tables, and all articles (basket)."""
    item = lambda c: F.regexp_replace(F.upper(strip(c)), "^MESH:\\s*", "")
    a = table(spark, d, "pmid_mesh").select(F.col("pmid").alias("basket"), item("mesh_id").alias("item"))
    numbers = F.regexp_extract_all("PubMedIDs", F.lit("([0-9]+)"), F.lit(1))
    b = table(spark, d, "ctd_interactions").select(F.explode(numbers).alias("basket"), item("ChemicalID").alias("item")).select(F.expr("try_cast(basket AS bigint)").alias("basket"), "item")
    both = a.unionByName(b)
    return both.where("item <> ''"), both.select("basket").where("basket is not null").distinct()


def item_pairs(spark: SparkSession, d: str, min_together: int, min_lift: float) -> DataFrame:
    items, articles = article_items(spark, d)
    x = cooccurrence.associations(items, articles.count(), min_together, min_lift)
    return x.select(F.col("item0").alias("mesh_id_0"), F.col("item1").alias("mesh_id_1"), "n0", "n1", "n01", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p3_all(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of items that share an article."""
    return item_pairs(spark, d, min_together=1, min_lift=0.0)


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p3_found with their figures."""
    return item_pairs(spark, d, min_together=5, min_lift=5.0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("mesh_id_0", "mesh_id_1")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leak.paraphrases(table(spark, d, "documents"), table(spark, d, "eval_items"))


def token_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens), kept as a table: tokenising is the dear part."""
    return cut(tokens.with_token_counts(table(spark, d, "documents")), "token-sizes")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_rates(token_sizes(spark, d), table(spark, d, "source_weights")).where("short").select("source")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_sizes(spark, d)
    return mixing.mix(sizes, cut(mixing.source_rates(sizes, table(spark, d, "source_weights")), "rates"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_sizes(spark, d)
    rates = cut(mixing.source_rates(sizes, table(spark, d, "source_weights")), "rates")
    return mixing.share_report(mixing.mix(sizes, rates), rates)


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Those of the statistics that SQL can say as well."""
    return p10_statistics(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in RATIOS])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    q = quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_words"), statistics=False)
    return q.where("kind <> 'prose'").select("doc_id", "kind")


def p9_rates_by_characters(spark: SparkSession, d: str) -> DataFrame:
    """The rates of the mixture for sizes that SQL can count as well: characters for tokens."""
    sizes = table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    r = mixing.source_rates(sizes, table(spark, d, "source_weights"))
    return r.select("source", "size", F.round("rate", 6).alias("rate"), "short")


RATIOS = ["n_chars", "n_words", "mean_word_length", "symbol_share", "digit_share"]


QUERIES = {
    "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_pairs": p3_pairs, "p3_all": p3_all, "p8_found": p8_found, "p8_paraphrases": p8_paraphrases,
    "p9_found": p9_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_rates_by_characters": p9_rates_by_characters, "p10_found": p10_found, "p10_statistics": p10_statistics, "p10_ratios": p10_ratios,
}


def _cell(c: str, pattern: str) -> str:
    v = f"upper(trim(split_part({c}, ':', -1), E' \\t\\n\\r'))"
    return f"SELECT mondo_id AS node, '{c}=' || {v} AS key FROM disease_nodes WHERE regexp_full_match({v}, '{pattern}') AND regexp_matches({v}, '[1-9]')"


_GROUPS = f"""member AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(_cell(c, p) for c, p in IDENTIFIERS.items())}) WHERE node IS NOT NULL),
low AS (SELECT key, min(node) AS a FROM member GROUP BY key), half AS (SELECT a, node AS b FROM member JOIN low USING (key) WHERE a <> node),
link AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT DISTINCT mondo_id AS node, mondo_id AS other FROM disease_nodes WHERE mondo_id IS NOT NULL UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.other)"""

_ITEM = "regexp_replace(upper(trim({c}, E' \\t\\n\\r')), '^MESH:\\s*', '')"
_OCC = f"""raw AS (SELECT pmid AS basket, {_ITEM.format(c='mesh_id')} AS item FROM pmid_mesh
  UNION ALL SELECT try_cast(b AS BIGINT), item FROM (SELECT unnest(regexp_extract_all(PubMedIDs, '[0-9]+')) AS b, {_ITEM.format(c='ChemicalID')} AS item FROM ctd_interactions)),
occ AS (SELECT DISTINCT basket, item FROM raw WHERE basket IS NOT NULL AND item <> ''),
total AS (SELECT count(DISTINCT basket) AS n FROM raw), marg AS (SELECT item, count(*) AS c FROM occ GROUP BY item),
pairs AS (SELECT a.item AS mesh_id_0, b.item AS mesh_id_1, count(*) AS n01 FROM occ a JOIN occ b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL HAVING count(*) >= 5),
found AS (SELECT mesh_id_0, mesh_id_1, x.c AS n0, y.c AS n1, n01, n FROM pairs JOIN marg x ON x.item = mesh_id_0 JOIN marg y ON y.item = mesh_id_1, total WHERE n01 * n >= 5 * x.c * y.c)"""

_ALL = """every AS (SELECT a.item AS mesh_id_0, b.item AS mesh_id_1, count(*) AS n01 FROM occ a JOIN occ b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL),
measured AS (SELECT mesh_id_0, mesh_id_1, x.c AS n0, y.c AS n1, n01, n FROM every JOIN marg x ON x.item = mesh_id_0 JOIN marg y ON y.item = mesh_id_1, total)"""

_GRAM = "SELECT {k}, w[i:i + 11] AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {k}, regexp_extract_all(strip_accents(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g'))), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}) WHERE len(w) >= 12)"

_WORDS = r"regexp_extract_all(regexp_replace(text, '</?[A-Za-z][^<>\r\n]*>', ' ', 'g'), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')"
_BARE = r"regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]', '', 'g')"

SQL = {
    "p9_rates_by_characters": """WITH s AS (SELECT lower(trim(source, E' \t\n\r')) AS source, sum(coalesce(length(text), 0))::BIGINT AS size FROM documents GROUP BY 1), w AS (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM source_weights),
x AS (SELECT w.source, coalesce(s.size, 0)::BIGINT AS size, target_share * (SELECT sum(size) FROM s) AS wanted, max_repeats FROM w LEFT JOIN s ON s.source = w.source)
SELECT source, size, round(CASE WHEN size > 0 THEN least(wanted / size, max_repeats) ELSE 0.0 END, 6) AS rate, size * max_repeats < wanted AS short FROM x""",
    "p10_ratios": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), x AS (SELECT doc_id, text, {_WORDS} AS w, greatest(length({_BARE}), 1) AS n FROM t)
SELECT doc_id, length(text)::DOUBLE AS n_chars, len(w)::DOUBLE AS n_words, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0.0 END, 6) AS mean_word_length,
  round((n - coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x))), 0)) / n, 6) AS symbol_share, round(coalesce(list_sum(list_transform(regexp_extract_all(text, '\\p{{Nd}}+'), lambda x: length(x))), 0) / n, 6) AS digit_share FROM x""",
    "p2_groups": f"WITH RECURSIVE {_GROUPS} SELECT node AS mondo_id, min(other) AS group_id FROM reach GROUP BY node",
    "p2_found": f"WITH RECURSIVE {_GROUPS} SELECT node AS mondo_id, min(other) AS group_id FROM reach GROUP BY node HAVING count(*) > 1",
    "p3_pairs": f"WITH {_OCC} SELECT mesh_id_0, mesh_id_1, n0, n1, n01, round(n01 * n / (n0 * n1), 6) AS lift, round(log2(n01 * n / (n0 * n1)), 6) AS pmi FROM found",
    "p3_all": f"WITH {_OCC}, {_ALL} SELECT mesh_id_0, mesh_id_1, n0, n1, n01, round(n01 * n / (n0 * n1), 6) AS lift, round(log2(n01 * n / (n0 * n1)), 6) AS pmi FROM measured",
    "p3_found": f"WITH {_OCC} SELECT mesh_id_0, mesh_id_1 FROM found",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAM.format(k='doc_id', t='documents')}) JOIN ({_GRAM.format(k='item_id', t='eval_items')}) USING (g)",
}
