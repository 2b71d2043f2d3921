"""The same results in DuckDB's SQL, for the correctness check."""

_LINKS = """links AS (
  SELECT DISTINCT * FROM (
    SELECT mondo_id AS child, 'MONDO:' || unnest(regexp_extract_all(is_a, '(?i)MONDO[:_]([0-9]{7})', 1)) AS parent FROM disease_nodes
    UNION ALL SELECT hp_id, 'HP:' || unnest(regexp_extract_all(is_a, '(?i)HP[:_]([0-9]{7})', 1)) FROM phenotype_nodes)
  WHERE child IS NOT NULL AND parent IS NOT NULL),
terms AS (SELECT mondo_id AS node FROM disease_nodes WHERE mondo_id IS NOT NULL UNION SELECT hp_id FROM phenotype_nodes WHERE hp_id IS NOT NULL),
reach AS (SELECT l.child AS node, l.parent AS up FROM links l WHERE l.parent IN (SELECT node FROM terms) UNION SELECT r.node, l.parent FROM reach r JOIN links l ON l.child = r.up WHERE l.parent IN (SELECT node FROM terms))"""

_PATHS = f"""{_LINKS}, cyc AS (SELECT a.node, min(b.node) AS cycle_id FROM reach a JOIN reach b ON a.up = b.node AND b.up = a.node GROUP BY a.node),
rep AS (SELECT node, cycle_id, coalesce(cycle_id, node) AS r FROM terms LEFT JOIN cyc USING (node)),
ce AS (SELECT DISTINCT a.r AS child, b.r AS parent FROM links JOIN rep a ON a.node = child JOIN rep b ON b.node = parent WHERE a.r <> b.r),
pth AS (SELECT DISTINCT r, r AS path, 0 AS depth, r AS root FROM rep WHERE r NOT IN (SELECT child FROM ce) UNION ALL SELECT ce.child, path || ' > ' || ce.child, depth + 1, root FROM pth JOIN ce ON ce.parent = pth.r)"""

_ENDS = """ends AS (SELECT edge_id, 'start' AS side, start_id AS node_id, rel_type, loaded_at FROM graph_edges
  UNION ALL SELECT edge_id, 'end', end_id, rel_type, loaded_at FROM graph_edges)"""

_BLANK = "regexp_full_match({c}, '[\\s\\x{{a0}}]*')"


def _there(c: str) -> str:
    return f"({c} IS NOT NULL AND NOT {_BLANK.format(c=c)})"


_ORPHANS = f"""{_ENDS},
refs AS (SELECT * FROM ends WHERE {_there('node_id')}),
orphans AS (SELECT r.edge_id, r.side, r.loaded_at, CASE WHEN count(n.id) = 0 THEN 'missing' WHEN bool_or(n.created_at <= r.loaded_at) THEN 'deleted' ELSE 'later' END AS kind
  FROM refs r LEFT JOIN graph_nodes n ON n.id = r.node_id GROUP BY r.edge_id, r.side, r.loaded_at
  HAVING NOT coalesce(bool_or(n.created_at <= r.loaded_at AND (n.deleted_at IS NULL OR n.deleted_at > r.loaded_at)), false))"""

_NODE_TABLES = {
    "disease_nodes": ["row_id", "load_no", "loaded_at", "mondo_id", "disease_name", "definition", "synonyms", "is_a", "umls_cui", "omim_id", "orpha_id", "doid", "icd10cm", "mesh_id", "snomed_id", "source_database"],
    "phenotype_nodes": ["row_id", "load_no", "loaded_at", "hp_id", "name", "definition", "synonyms", "is_a", "source_database"],
    "genes": ["row_id", "load_no", "loaded_at", "GeneID", "Symbol", "Synonyms", "dbXrefs", "chromosome", "description", "type_of_gene", "Full_name_from_nomenclature_authority", "source_database"],
    "chemical_nodes": ["row_id", "load_no", "loaded_at", "chemical_id", "chemical_name", "mesh_id", "cas_number", "pubchem_cid", "inchikey", "dtxsid", "mesh_parent_ids", "source_database"],
    "graph_nodes": ["id", "node_type", "source_key", "source_database", "created_at", "deleted_at"],
}


def _cells(cols: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT {'NULL::BIGINT AS row_id' if t == 'graph_nodes' else 'row_id'}, '{t}' AS table_name, '{c}' AS column_name, {'NULL::INTEGER AS load_no' if t == 'graph_nodes' else 'load_no'}, CAST({c} AS VARCHAR) AS value FROM {t}" for t, cs in cols.items() for c in cs)


def _stats(cols: dict[str, list[str]]) -> str:
    return f"""cells AS ({_cells(cols)}),
s AS (SELECT table_name, column_name, load_no, count(*) AS n, count(*) FILTER ({_there('value')}) AS there, count(DISTINCT value) FILTER ({_there('value')}) AS "distinct", coalesce(sum(length(value)) FILTER ({_there('value')}), 0)::BIGINT AS chars FROM cells GROUP BY ALL),
stats AS (SELECT table_name, column_name, load_no, n, n - there AS nulls, there, "distinct", chars,
  (sum(n) OVER w - n)::BIGINT AS o_n, (sum(n - there) OVER w - (n - there))::BIGINT AS o_nulls, (sum(there) OVER w - there)::BIGINT AS o_there, (sum(chars) OVER w - chars)::BIGINT AS o_chars
  FROM s WINDOW w AS (PARTITION BY table_name, column_name))"""


_FORMAT = """CASE WHEN table_name = 'disease_nodes' AND column_name = 'umls_cui' THEN NOT regexp_full_match(value, 'C[0-9]{7}')
  WHEN table_name = 'chemical_nodes' AND column_name = 'inchikey' THEN NOT regexp_full_match(value, '[A-Z]{14}-[A-Z]{10}-[A-Z]')
  WHEN table_name = 'disease_nodes' AND column_name = 'definition' THEN NOT regexp_full_match(value, '[A-Z][A-Za-z0-9 ,;:()''/.-]{18,}\\.') ELSE false END"""

_PACKED = {
    ("disease_nodes", "synonyms"): "list_filter(list_transform(regexp_extract_all(synonyms, '\"(?:[^\"]|\"\")*\"|[\\p{L}\\p{M}\\p{N} ,''().\\-]+'), lambda v: trim(CASE WHEN v[1] = '\"' THEN replace(v[2:-2], '\"\"', '\"') ELSE v END, E' \\t\\n\\r')), lambda v: regexp_matches(v, '[\\p{L}\\p{M}\\p{N}]'))",
    ("genes", "dbXrefs"): "list_filter(regexp_extract_all(dbXrefs, '[\\p{L}\\p{M}\\p{N}:./_\\-]+'), lambda v: contains(v, ':'))",
    ("ctd_interactions", "PubMedIDs"): "regexp_extract_all(PubMedIDs, '[0-9]+')",
    ("disease_nodes", "is_a"): "list_transform(regexp_extract_all(is_a, '(?i)MONDO[:_]([0-9]{7})', 1), lambda v: 'MONDO:' || v)",
}

#: What is left of a text without its quoted parts still has a quote.
_UNCLOSED = """coalesce(contains(regexp_replace(synonyms, '"(?:[^"]|"")*"', '', 'g'), '"'), false)"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT a.node AS term_id, min(b.node) AS cycle_id FROM reach a JOIN reach b ON a.up = b.node AND b.up = a.node GROUP BY a.node",
    "p1_hierarchy": f"WITH RECURSIVE {_PATHS} SELECT node AS term_id, cycle_id, min(depth)::INTEGER AS depth_min, max(depth)::INTEGER AS depth_max, count(*) AS n_paths, string_agg(DISTINCT root, '|' ORDER BY root) AS roots FROM rep JOIN pth USING (r) GROUP BY node, cycle_id",
    "p1_paths": f"WITH RECURSIVE {_PATHS} SELECT node AS term_id, path FROM rep JOIN pth USING (r)",
    "p1_descendants": f"WITH RECURSIVE {_LINKS} SELECT up AS term_id, node AS descendant_id FROM reach WHERE node IN (SELECT node FROM terms)",
    "p4_found": f"WITH {_ENDS} SELECT side, node_id FROM ends WHERE {_there('node_id')} GROUP BY side, node_id HAVING count(*) * 50 >= (SELECT count(*) FROM graph_edges)",
    "p4_nodes": f"""WITH {_ENDS}, t AS (SELECT side, node_id, coalesce(rel_type, '') AS rel_type, count(*) AS n, min(loaded_at) AS a, max(loaded_at) AS b FROM ends GROUP BY ALL)
SELECT side, node_id, sum(n)::BIGINT AS degree, string_agg(rel_type || '=' || n, ';' ORDER BY rel_type) AS by_rel_type, epoch_us(min(a)) AS first_us, epoch_us(max(b)) AS last_us FROM t GROUP BY side, node_id""",
    "p5_found": f"""WITH {_stats({'disease_nodes': ['definition', 'umls_cui'], 'chemical_nodes': ['inchikey']})},
judged AS (SELECT * FROM stats WHERE load_no IS NOT NULL AND n >= 20)
SELECT table_name, column_name, 'format' AS kind, row_id AS ref_id FROM cells WHERE {_there('value')} AND {_FORMAT}
UNION ALL SELECT table_name, column_name, 'nulls', load_no::BIGINT FROM judged WHERE o_n > 0 AND abs(nulls / n - o_nulls / o_n) >= 0.2 - 1e-9
UNION ALL SELECT table_name, column_name, 'length', load_no::BIGINT FROM judged WHERE column_name = 'definition' AND there > 0 AND o_there > 0 AND ((chars / there) >= 1.5 * (o_chars / o_there) OR (chars / there) * 1.5 <= (o_chars / o_there))
UNION ALL SELECT table_name, column_name, 'repeats', load_no::BIGINT FROM judged WHERE column_name <> 'definition' AND there > 0 AND there >= 2 * "distinct\"""",
    "p5_loads": f"WITH {_stats(_NODE_TABLES)} SELECT * FROM stats",
    "p5_profile": f"""WITH cells AS ({_cells(_NODE_TABLES)}), v AS (SELECT table_name, column_name, CASE WHEN {_there('value')} THEN value END AS value FROM cells),
g AS (SELECT table_name, column_name, value, count(*) AS n FROM v GROUP BY ALL)
SELECT table_name, column_name, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (value IS NULL), 0)::BIGINT AS n_null, round(coalesce(sum(n) FILTER (value IS NULL), 0) / sum(n), 6) AS null_rate, count(value) AS n_distinct,
  CASE WHEN column_name IN ('row_id', 'load_no') THEN min(try_cast(value AS BIGINT))::VARCHAR ELSE min(value) END AS min_value, CASE WHEN column_name IN ('row_id', 'load_no') THEN max(try_cast(value AS BIGINT))::VARCHAR ELSE max(value) END AS max_value, min(length(value))::INTEGER AS min_length, max(length(value))::INTEGER AS max_length,
  round(coalesce(greatest(log2(sum(n) FILTER (value IS NOT NULL)) - sum(n * log2(n)) FILTER (value IS NOT NULL) / sum(n) FILTER (value IS NOT NULL), 0.0), 0.0), 6) AS entropy_bits,
  CASE WHEN (table_name, column_name) IN (('disease_nodes', 'umls_cui'), ('disease_nodes', 'definition'), ('chemical_nodes', 'inchikey')) THEN coalesce(sum(n) FILTER (value IS NOT NULL AND {_FORMAT}), 0)::BIGINT END AS n_format FROM g GROUP BY table_name, column_name""",
    "p6_found": f"WITH {_ORPHANS} SELECT edge_id, side, kind FROM orphans",
    "p6_report": f"WITH {_ORPHANS} SELECT side, kind, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n FROM orphans GROUP BY ALL",
    "p7_found": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, row_id, generate_subscripts(v, 1)::INTEGER AS pos, unnest(v) AS value FROM (SELECT row_id, {e} AS v FROM {t})" for (t, c), e in _PACKED.items()),
    "p7_flags": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, row_id, flag FROM (SELECT row_id, CASE WHEN {_UNCLOSED if c == 'synonyms' else 'false'} THEN 'unclosed_quote' WHEN {_there(c)} AND len({e}) = 0 THEN 'no_value' END AS flag FROM {t}) WHERE flag IS NOT NULL" for (t, c), e in _PACKED.items()),
}
