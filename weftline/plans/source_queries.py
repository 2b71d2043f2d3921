"""Queries of the sources' plans and readers. The domain's tables are laid out as each
source's raw input, the plan is run, and the SQL says what it must give. Readers
and sinks are tested by writing a table in their format and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.graph import build, export
from weftline.metrics import graph as gm
from weftline.operators.rows import keep_first
from weftline.plans.reference import dimension_products, query
from weftline.plans.tables import table
from weftline.sources import obo as obo_reader
from weftline.sources import readers, registry
from weftline.sources import tables as src
from weftline.storage import scratch_path, write_small

_WS = "E' \\t\\n\\r\\f\\x0b '"


def _strip(c: str) -> str:
    return f"trim({c}, {_WS})"


def _line(c: str) -> str:
    return _strip(f"regexp_replace({c}, '[\\r\\n\\t]+', ' ', 'g')")


# Ontology files: the first row of each disease as a term

_TAGS = ["[]", "['uberon_slim']", "['uberon_slim', 'upper_level']", "['grouping_class']", "['uberon_slim', 'other']"]
_XREFS = {"UMLS:": "umls_cui", "UMLS_CUI:": "umls_cui", "OMIM:": "omim_id", "MIM:": "omim_id", "DOID:": "doid", "MESH:": "mesh_id", "SNOMEDCT_US_2020:": "snomed_id", "SNOMEDCT:": "snomed_id", "ICD10CM:": "icd10cm", "Orphanet:": "orpha_id", "FMA:": "orpha_id"}


def terms(s: SparkSession, d: str, prefix: str) -> DataFrame:
    """(row_id and) the columns of obo.terms."""
    t = keep_first(table(s, d, "disease_nodes").where("mondo_id is not null"), ["mondo_id"], ["row_id"])
    ups = F.transform(F.regexp_extract_all("is_a", F.lit("(?i)MONDO[:_]([0-9]{7})"), F.lit(1)), lambda x: F.concat(F.lit(f"{prefix}:"), x, F.lit(" ! parent")))
    tags = F.element_at(F.array(*[F.expr(f"cast(array({x[1:-1]}) as array<string>)") for x in _TAGS]), (F.col("row_id") % len(_TAGS) + 1).cast("int"))
    return t.select(
        "row_id", F.concat(F.lit(f"{prefix}:"), F.substring("mondo_id", 7, 99)).alias("id"), F.col("disease_name").alias("name"), F.concat(F.lit('"'), "definition", F.lit('" [src:'), F.col("row_id").cast("string"), F.lit("]")).alias("def"),
        F.element_at(F.array(*map(F.lit, src.NAMESPACES)), (F.col("row_id") % 3 + 1).cast("int")).alias("namespace"), (F.col("load_no") == 8).alias("is_obsolete"), tags.alias("subset"),
        F.array_compact(F.array(*[F.concat(F.lit(p), c) for p, c in _XREFS.items()])).alias("xref"), F.transform(F.filter(F.split(F.coalesce("synonyms", F.lit("")), ";"), lambda x: ~x.contains('"') & (F.trim(x) != "")), lambda x: F.concat(F.lit('"'), x, F.lit('" EXACT []'))).alias("synonym"),
        F.coalesce(ups, F.array().cast("array<string>")).alias("is_a"), F.transform(F.coalesce(ups, F.array().cast("array<string>")), lambda x: F.concat(F.lit("part_of "), x)).alias("relationship"))


def _terms(prefix: str) -> str:
    ups = f"coalesce(list_transform(regexp_extract_all(is_a, '(?i)MONDO[:_]([0-9]{{7}})', 1), lambda x: '{prefix}:' || x), [])"
    return f"""term AS (SELECT row_id, '{prefix}:' || mondo_id[7:] AS id, coalesce(disease_name, '') AS name, coalesce({_line("rtrim(definition, chr(34))")}, '') AS def, coalesce({_line("regexp_replace(split_part(definition || chr(34) || ' [s', ' [', 1), chr(34) || '$', '')")}, '') AS first_def, (list_value('biological_process', 'molecular_function', 'cellular_component'))[row_id % 3 + 1] AS namespace, load_no = 8 AS is_obsolete,
  CASE row_id % {len(_TAGS)} {' '.join(f"WHEN {i} THEN {x}::VARCHAR[]" for i, x in enumerate(_TAGS))} END AS subset, umls_cui, omim_id, orpha_id, doid, icd10cm, mesh_id, snomed_id, {ups} AS up,
  array_to_string(list_filter(string_split(coalesce(synonyms, ''), ';'), lambda x: NOT contains(x, chr(34)) AND trim(x) <> ''), '|') AS synonyms
  FROM (SELECT *, row_number() OVER (PARTITION BY mondo_id ORDER BY row_id) AS rn FROM disease_nodes WHERE mondo_id IS NOT NULL) WHERE rn = 1)"""


@query(f"WITH {_terms('MONDO')} SELECT id AS mondo_id, name AS disease_name, def AS definition, synonyms, array_to_string(up, '|') AS is_a, coalesce(umls_cui, '') AS umls_cui, coalesce(omim_id, '') AS omim_id, coalesce(orpha_id, '') AS orpha_id, coalesce(doid, '') AS doid, coalesce(icd10cm, '') AS icd10cm, coalesce(mesh_id, '') AS mesh_id, coalesce(snomed_id, '') AS snomed_id, 'MONDO' AS source_database FROM term WHERE NOT is_obsolete AND NOT list_contains(subset, 'grouping_class') AND NOT list_contains(subset, 'upper_level') AND (contains(lower(name), 'deficiency') OR omim_id = '171715' OR umls_cui = 'C0033283')")
def src_mondo(s, d):
    t = terms(s, d, "MONDO")
    return src.mondo(t, {"terms": ["Deficiency"], "umls": ["C0033283"], "omim": ["171715"]})["disease_nodes"]


def _disease_root(s, d) -> str:
    """The first id among those that most terms name as their parent."""
    up = terms(s, d, "DOID").select(F.explode("is_a").alias("p")).select(F.substring_index("p", " ", 1).alias("p")).groupBy("p").count()
    return up.agg(F.min_by("p", F.struct(-F.col("count"), F.col("p")))).first()[0]


@query(f"""WITH RECURSIVE {_terms('DOID')}, root AS (SELECT arg_min(p, (-n, p)) AS r FROM (SELECT p, count(*) AS n FROM (SELECT unnest(up) AS p FROM term) GROUP BY p)),
bfs AS (SELECT r AS node, 0 AS depth FROM root UNION SELECT id, depth + 1 FROM bfs, (SELECT id, unnest(up) AS p FROM term) WHERE p = node AND depth < 60), best AS (SELECT node, min(depth) AS depth FROM bfs GROUP BY node),
par AS (SELECT id, unnest(up) AS p FROM term), broad AS (SELECT id FROM par LEFT JOIN best ON node = p GROUP BY id HAVING max(coalesce(depth, 999)) <= 1)
SELECT id AS doid, name AS disease_name, {_strip("rtrim(def, ',;.')")} AS definition, coalesce(umls_cui, '') AS umls_cui, coalesce(mesh_id, '') AS mesh_id, coalesce(omim_id, '') AS omim_id, '' AS ncit_id, coalesce(icd10cm, '') AS icd10cm, '' AS icd9cm, '' AS ordo_id, '' AS gard_id, coalesce(snomed_id, '') AS snomed_id, '' AS symptoms, 'Disease Ontology' AS source_database
FROM term WHERE NOT is_obsolete AND (id LIKE '%5' OR contains(lower(name), 'syndrome') OR contains(lower(name), 'anomaly')) AND id NOT IN (SELECT id FROM broad)""")
def src_disease_ontology(s, d):
    t = terms(s, d, "DOID")
    slim = t.where("id like '%5'").select(F.col("id").alias("doid"))
    return src.disease_ontology(t, slim, {"terms": ["Syndrome", "anomaly"]}, _disease_root(s, d))["slim_terms"].withColumn("definition", F.regexp_replace("definition", r"(?U)\s+$", ""))


@query(f"""WITH {_terms('UBERON')} SELECT id AS uberon_id, name AS uberon_name, synonyms, coalesce(regexp_extract('"' || t.definition || '"', '(?s)^"(.*?)"', 1), '') AS definition, coalesce('MESH:' || term.mesh_id, '') AS mesh_id, coalesce('FMA:' || term.orpha_id, '') AS fma_id, '' AS bto_id, array_to_string(subset, '|') AS subsets, 1 AS is_human, array_to_string(up, '|') AS is_a, array_to_string(up, '|') AS part_of, 'Uberon' AS source_database
FROM term JOIN (SELECT row_id AS r, definition FROM disease_nodes) t ON t.r = row_id WHERE NOT is_obsolete AND row_id % 3 <> 0 AND list_contains(subset, 'uberon_slim') AND NOT list_contains(subset, 'upper_level')""")
def src_uberon(s, d):
    t = terms(s, d, "UBERON")
    return src.uberon(t, t.where("row_id % 3 <> 0"))["uberon_nodes"]


@query(f"WITH {_terms('HP')} SELECT id AS hp_id, name, first_def AS definition, synonyms, array_to_string(up, '|') AS is_a, 'HPO' AS source_database FROM term WHERE NOT is_obsolete")
def src_hpo_terms(s, d):
    return src.hpo(terms(s, d, "HP"))["phenotype_nodes"]


@query(f"""WITH ann AS (SELECT trim(end_id) AS db, trim(start_id) AS hp, CASE WHEN edge_id % 4 = 0 THEN 'NOT' ELSE '' END AS q, coalesce(props['evidence'], '') AS ev FROM graph_edges),
m AS (SELECT 'OMIM:' || GeneID AS k, arg_max(Symbol, row_id) AS cui FROM genes WHERE GeneID IS NOT NULL AND Symbol IS NOT NULL GROUP BY 1)
SELECT DISTINCT 'HP:' || hp AS hp_id, coalesce(cui, '') AS cui, ev AS evidence, '' AS onset, '' AS frequency, '' AS sex, 'HPO' AS source_database FROM ann LEFT JOIN m ON k = 'OMIM:' || replace(db, 'gene_', '') WHERE db <> '' AND hp IS NOT NULL AND q <> 'NOT'""")
def src_hpo_annotations(s, d):
    e = table(s, d, "graph_edges")
    ann = e.select(F.when(F.trim("end_id") != "", F.concat(F.lit(" OMIM:"), F.replace(F.trim("end_id"), F.lit("gene_"), F.lit("")))).alias("database_id"), F.when(F.col("edge_id") % 4 == 0, "NOT").otherwise("").alias("qualifier"), F.concat(F.lit("HP:"), F.trim("start_id")).alias("hpo_id"), F.col("props")["evidence"].alias("evidence"), F.lit("").alias("onset"), F.lit(None).cast("string").alias("frequency"), F.lit("").alias("sex"))
    med = table(s, d, "genes").where("GeneID is not null and Symbol is not null").select(F.col("Symbol").alias("cui"), F.lit("n").alias("pref_name"), F.col("GeneID").alias("source_id"), F.lit("OMIM").alias("source"), F.col("row_id").alias("_ord"))
    return src.hpo(None, ann, med)["disease_phenotype_positive"]


_GO = f"""WITH {_terms('GO')} SELECT id AS go_id, name, first_def AS definition, 'Gene Ontology' AS source_database FROM term WHERE NOT is_obsolete AND namespace = 'molecular_function'"""
_EV = "['" + "', '".join(src.EVIDENCE) + "']"


def _gaf(s, d):
    e, k = table(s, d, "graph_edges"), F.col("edge_id")
    return e.select(F.when(k % 5 == 0, "RNAcentral").otherwise("UniProtKB").alias("DB"), F.col("start_id").alias("DB_Object_Symbol"), F.when(k % 7 == 0, "NOT|involved_in").when(k % 7 == 1, None).otherwise("involved_in").alias("Qualifier"), F.col("end_id").alias("GO_ID"),
        F.element_at(F.array(*map(F.lit, src.EVIDENCE)), (k % len(src.EVIDENCE) + 1).cast("int")).alias("Evidence_Code"), F.element_at(F.array(F.lit("P"), F.lit("F"), F.lit("C")), (F.length("rel_type") % 3 + 1).cast("int")).alias("Aspect"), F.when(k % 11 == 0, "taxon:10090").otherwise("taxon:9606|taxon:1").alias("Taxon"))


@query(_GO)
def src_gene_ontology_nodes(s, d):
    return src.gene_ontology(terms(s, d, "GO"), _gaf(s, d))["molecular_function_nodes"]


@query(f"""WITH g AS (SELECT start_id, end_id, edge_id % {len(src.EVIDENCE)} AS rank FROM graph_edges WHERE edge_id % 5 <> 0 AND edge_id % 7 <> 0 AND edge_id % 11 <> 0 AND length(rel_type) % 3 = 1)
SELECT start_id AS gene_symbol, end_id AS go_id, ({_EV})[min(rank) + 1] AS evidence, 'Gene Ontology' AS source_database FROM g GROUP BY start_id, end_id""")
def src_gene_ontology_annotations(s, d):
    return src.gene_ontology(terms(s, d, "GO"), _gaf(s, d))["gene_mf_associations"]


@query("SELECT chemical_id AS mesh_id, chemical_name AS mesh_name, 'MeSH' AS \"sourceDatabase\" FROM chemical_nodes WHERE len(list_filter(string_split(mesh_parent_ids, '|'), lambda x: starts_with(x, 'MESH:D00') AND length(x) > 8)) > 0")
def src_mesh(s, d):
    t = table(s, d, "chemical_nodes").select(F.col("chemical_id").alias("mesh_id"), F.col("chemical_name").alias("mesh_name"), F.transform(F.split("mesh_parent_ids", r"\|"), lambda x: F.concat(F.substring(x, 1, 8), F.lit("."), F.substring(x, 9, 99))).alias("tree_numbers"))
    return src.mesh(t, "MESH:D00")["symptom_nodes"]


# Genes and interactions

_SECONDARY = """(regexp_matches("Symbol", '-(AS|OT|IT)[0-9]+$') OR contains(lower(coalesce(description, '')), 'readthrough') OR contains(lower(coalesce(description, '')), 'uncharacterized') OR coalesce(regexp_full_match("Symbol", 'LOC[0-9]+|LINC[0-9]+'), false))"""
_KV = "list_filter(list_transform(string_split(CASE WHEN {c} <> '-' THEN {c} ELSE '' END, '|'), lambda e: trim(e, E' \\t\\n\\r')), lambda e: strpos(e, ':') > 1)"


def _kv(key: str) -> str:
    return f"trim(list_last(list_filter({_KV.format(c='dbXrefs')}, lambda e: trim(split_part(e, ':', 1)) = '{key}'))[{len(key) + 2}:])"


@query(f"SELECT GeneID, Symbol, chromosome, {_kv('HGNC')} AS \"xref_HGNC\", CASE WHEN NOT coalesce({_SECONDARY}, false) THEN {_kv('Ensembl')} END AS \"xref_Ensembl\", 'NCBIGene' AS source_database FROM genes WHERE load_no <= 6")
def src_ncbigene(s, d):
    g = table(s, d, "genes").withColumn("tax_id", F.when(F.col("load_no") <= 6, "9606").otherwise("10090"))
    w = src.widen(src.ncbigene(g)["genes"], "xrefs", "xref_", ["HGNC", "Ensembl"])
    return w.select("GeneID", "Symbol", "chromosome", "xref_HGNC", "xref_Ensembl", "source_database")


_SOURCES = ["Ensembl_HGNC_entrez_id", "UniProt_DR_GeneID", "KEGG_GENEID", "BLAST_name"]


@query(f"""WITH al AS (SELECT 'gene_' || GeneID AS p, GeneID || ':' || (row_id % 3) AS alias, row_id % 4 AS rank FROM genes WHERE row_id % 4 < 3 AND GeneID IS NOT NULL), best AS (SELECT p, arg_min(alias, (rank, alias)) AS alias FROM al GROUP BY p),
li AS (SELECT edge_id, start_id, end_id, CAST(round(TRY_CAST(props['score'] AS DOUBLE) * 1000) AS BIGINT) AS sc FROM graph_edges WHERE rel_type = 'geneInteractsWithGene'),
j AS (SELECT a.alias AS a, b.alias AS b, sc, edge_id FROM li JOIN best a ON a.p = start_id JOIN best b ON b.p = end_id WHERE sc >= 700)
SELECT a AS gene_id_1, b AS gene_id_2, arg_min(sc, edge_id) AS combined_score, 'STRING' AS source_database FROM j GROUP BY a, b""")
def src_string(s, d):
    al = table(s, d, "genes").where("GeneID is not null").select(F.concat(F.lit("9606.gene_"), "GeneID").alias("string_protein_id"), F.concat("GeneID", F.lit(":"), (F.col("row_id") % 3).cast("string")).alias("alias"), F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("row_id") % 4 + 1).cast("int")).alias("source"))
    li = table(s, d, "graph_edges").where("rel_type = 'geneInteractsWithGene'").select(F.concat(F.lit("9606."), "start_id").alias("protein1"), F.concat(F.lit("9606."), "end_id").alias("protein2"), F.round(F.col("props")["score"].try_cast("double") * 1000).cast("long").alias("combined_score"), F.col("edge_id").alias("_ord"))
    return src.string_ppi(li, al)["gene_interactions"]


@query("""WITH c AS (SELECT edge_id, start_id, CASE WHEN edge_id % 7 = 0 THEN 'nan'::DOUBLE ELSE round(TRY_CAST(props['score'] AS DOUBLE) * 100, 3) END AS sc FROM graph_edges WHERE edge_id % 3 <> 0 AND edge_id % 5 <> 0)
SELECT 'UBERON:' || (edge_id % 50) AS uberon_id, start_id AS ensembl_gene_id, 'present' AS expression_call, 'gold' AS call_quality, 0.01::DOUBLE AS fdr, sc AS expression_score, 5.0::DOUBLE AS expression_rank, true AS unbiased, 'Bgee' AS "sourceDatabase" FROM c WHERE sc > 60 AND NOT isnan(sc)""")
def src_bgee(s, d):
    k = F.col("edge_id")
    score = F.when(k % 7 == 0, "NaN").otherwise(F.round(F.col("props")["score"].try_cast("double") * 100, 3).cast("string"))
    c = table(s, d, "graph_edges").select(F.col("start_id").alias("gene_id"), F.when(k % 3 == 0, "CL:1").otherwise(F.concat(F.lit("UBERON:"), (k % 50).cast("string"))).alias("anatomical_entity_id"), F.when(k % 5 == 0, "absent").otherwise("present").alias("expression"), F.lit("gold").alias("call_quality"), F.lit("0.01").alias("fdr"), score.alias("expression_score"), F.lit("5").alias("expression_rank"))
    return src.bgee(c, 60.0)["anatomy_expresses_gene"]


_FLAGS = ["is_directed", "is_stimulation", "is_inhibition", "consensus_direction", "consensus_stimulation", "consensus_inhibition"]


@query(f"SELECT start_id AS tf_symbol, end_id AS target_gene, {', '.join(f'((edge_id >> {i}) % 2)::INTEGER AS {f}' for i, f in enumerate(_FLAGS))}, 'CollecTRI' AS source_database FROM graph_edges WHERE start_id IS NOT NULL AND end_id IS NOT NULL")
def src_collectri(s, d):
    i = table(s, d, "graph_edges").select(F.col("start_id").alias("source_genesymbol"), F.col("end_id").alias("target_genesymbol"), *[(F.shiftright("edge_id", i) % 2).cast("string").alias(f) for i, f in enumerate(_FLAGS)])
    return src.collectri(i)["tf_gene_interactions"]


@query("""SELECT 'tf' || l_suppkey AS tf_symbol, 'g' || l_partkey AS target_gene, 's' || l_suppkey AS tf_uniprot, 't' || l_partkey AS target_uniprot, CASE l_returnflag WHEN 'A' THEN 'A;D' WHEN 'R' THEN 'E' ELSE 'B' END AS confidence, l_quantity AS curation_effort,
CASE WHEN l_linenumber % 2 = 1 AND l_linestatus <> 'O' THEN 'activation' WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'repression' WHEN l_linestatus = 'O' THEN 'dual' ELSE 'unknown' END AS mode_of_regulation, CASE WHEN l_linenumber % 2 = 1 AND l_linestatus <> 'O' THEN 1 WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN -1 ELSE 0 END AS mor_score,
true AS is_directed, 'TRANSCRIPTION_FACTOR_INTERACTS_WITH_GENE' AS relationship, 'DoRothEA' AS source_database FROM lineitem WHERE l_returnflag <> 'R'""")
def src_dorothea(s, d):
    t = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    level = F.when(F.col("l_returnflag") == "A", "A;D").when(F.col("l_returnflag") == "R", "E").otherwise("B")
    i = table(s, d, "lineitem").select(t("s", "l_suppkey").alias("source"), t("t", "l_partkey").alias("target"), t("tf", "l_suppkey").alias("source_genesymbol"), t("g", "l_partkey").alias("target_genesymbol"), F.lit(True).alias("is_directed"), (F.col("l_linenumber") % 2 == 1).alias("is_stimulation"), F.when(F.col("l_linestatus") == "O", True).alias("is_inhibition"), F.col("l_quantity").alias("curation_effort"), level.alias("dorothea_level"))
    return src.dorothea(i)["tf_gene_interactions"]


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS ncbi_gene_id, 'R-' || l_partkey AS reactome_id, l_returnflag AS evidence_code, 'Reactome' AS source_database FROM lineitem WHERE l_linestatus = 'O'")
def src_reactome(s, d):
    species = lambda c: F.when(c, "Homo sapiens").otherwise("Mus musculus").alias("species")
    p = table(s, d, "part").select(F.concat(F.lit("R-"), "p_partkey").alias("reactome_id"), F.col("p_name").alias("pathway_name"), species(F.col("p_size") > 10))
    g = table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("ncbi_gene_id"), F.concat(F.lit("R-"), "l_partkey").alias("reactome_id"), F.lit("u").alias("url"), F.lit("n").alias("name"), F.col("l_returnflag").alias("evidence_code"), species(F.col("l_linestatus") == "O"))
    return src.reactome(p, g)["ncbi_gene_pathway_relationships"]


@query("SELECT 'R-' || p_partkey AS reactome_id, p_name AS pathway_name, 'Homo sapiens' AS species, 'Reactome' AS source_database FROM part WHERE p_size > 10")
def src_reactome_pathways(s, d):
    p = table(s, d, "part").select(F.concat(F.lit("R-"), "p_partkey").alias("reactome_id"), F.col("p_name").alias("pathway_name"), F.when(F.col("p_size") > 10, "Homo sapiens").otherwise("Mus musculus").alias("species"))
    return src.reactome(p, p.limit(0).selectExpr("'' as ncbi_gene_id", "reactome_id", "'' as evidence_code", "species"))["pathways"]


# Chemicals and drugs

_CTD = f"""e AS (SELECT row_id, ChemicalName, CASE WHEN starts_with({_strip('ChemicalID')}, 'MESH:') OR {_strip('ChemicalID')} = '' THEN {_strip('ChemicalID')} ELSE 'MESH:' || {_strip('ChemicalID')} END AS chemical_id, {_strip('GeneID')} AS gene_id, coalesce({_strip('Interaction')}, '') AS interaction_text, coalesce({_strip('OrganismID')}, '') AS organism, coalesce(PubMedIDs, '') AS pubmed_id, unnest(string_split(InteractionActions, '|')) AS action FROM ctd_interactions WHERE ChemicalID IS NOT NULL AND {_strip("coalesce(GeneID, '')")} <> '')"""


def _ctd(direction: str):
    @query(f"WITH {_CTD} SELECT DISTINCT chemical_id, gene_id, interaction_text, organism, pubmed_id, 'CTD' AS source_database FROM e WHERE chemical_id <> '' AND lower(action) LIKE '{direction}^expression%'")
    def q(s, d):
        return src.ctd_chemical(table(s, d, "ctd_interactions"))[f"chemical_{direction}_expression"]

    return q


def _rename(name: str, f):
    from weftline.plans.reference import QUERIES, SQL

    QUERIES[name], SQL[name] = QUERIES.pop(f.__name__), SQL.pop(f.__name__)


_rename("src_ctd_increases_expression", _ctd("increases"))
_rename("src_ctd_decreases_expression", _ctd("decreases"))


@query(f"""WITH {_CTD}, c AS (SELECT chemical_id, arg_min(coalesce(ChemicalName, ''), row_id) AS chemical_name FROM e WHERE chemical_id <> '' AND contains(lower(action), '^expression') GROUP BY chemical_id),
v AS (SELECT CASE WHEN starts_with(k, 'MESH:') OR k = '' THEN k ELSE 'MESH:' || k END AS k, cas_number, pubchem_cid, inchikey, dtxsid, mesh_parent_ids FROM (SELECT {_strip('chemical_id')} AS k, * FROM (SELECT *, row_number() OVER (PARTITION BY {_strip('chemical_id')} ORDER BY row_id) AS rn FROM chemical_nodes WHERE chemical_id IS NOT NULL) WHERE rn = 1))
SELECT chemical_id, chemical_name, chemical_id AS mesh_id, CASE WHEN v.k IS NOT NULL THEN coalesce({_strip('cas_number')}, '') END AS cas_number, CASE WHEN v.k IS NOT NULL THEN ltrim(coalesce({_strip('pubchem_cid')}, ''), 'CID:') END AS pubchem_cid, CASE WHEN v.k IS NOT NULL THEN coalesce({_strip('inchikey')}, '') END AS inchikey, CASE WHEN v.k IS NOT NULL THEN coalesce({_strip('dtxsid')}, '') END AS dtxsid, CASE WHEN v.k IS NOT NULL THEN coalesce({_strip('mesh_parent_ids')}, '') END AS mesh_parent_ids, 'CTD' AS source_database FROM c LEFT JOIN v ON v.k = chemical_id""")
def src_ctd_nodes(s, d):
    i = table(s, d, "ctd_interactions").withColumn("_ord", F.col("row_id")).withColumn("ChemicalName", F.coalesce("ChemicalName", F.lit("")))
    v = table(s, d, "chemical_nodes").where("chemical_id is not null").select(F.col("chemical_id").alias("ChemicalID"), F.col("cas_number").alias("CasRN"), F.col("pubchem_cid").alias("PubChemCID"), F.col("dtxsid").alias("DTXSID"), F.col("inchikey").alias("InChIKey"), F.col("mesh_parent_ids").alias("ParentIDs"), F.col("row_id").alias("_ord"))
    return src.ctd_chemical(i, v)["chemical_nodes"]


#: An event per interaction: its chemical and the next id as stressors, its genes, its article's diseases.
_EVENTS = """ev AS (SELECT row_id, coalesce(ChemicalName, '') AS cn, coalesce(trim(ChemicalID), '') AS cid, coalesce(GeneSymbol, '') AS gs, coalesce(trim(GeneID), '') AS gid, row_id % 40 AS dis, row_id % 30 AS go FROM ctd_interactions)"""


def _events(s, d):
    t, k = table(s, d, "ctd_interactions"), F.col("row_id")
    txt = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return t.select(
        F.concat(F.coalesce("ChemicalName", F.lit("")), F.lit("^"), txt("ChemicalID"), F.lit("^MESH|lone| ^ ^|extra^D"), (k % 9).cast("string")).alias("Stressors"), F.concat(F.coalesce("GeneSymbol", F.lit("")), F.lit("^"), F.when(k % 6 == 0, "chemical").otherwise("GENE"), F.lit("^"), txt("GeneID"), F.lit("|short^gene")).alias("Receptors"),
        F.concat(F.lit("flu^D"), (k % 40).cast("string"), F.lit("^M|x^ ")).alias("Diseases"), F.concat(F.lit("a^GO:"), (k % 30).cast("string"), F.lit("^GO|b^XX:1")).alias("GOTerms"), F.concat(F.lit(" "), (k % 100).cast("string"), F.lit(" ")).alias("PubmedID"), k.alias("_ord"))


_STRESS = "st AS (SELECT row_id, cid AS x FROM ev WHERE cid <> '' UNION ALL SELECT row_id, 'D' || (row_id % 9) FROM ev)"


@query(f"WITH {_EVENTS}, {_STRESS} SELECT DISTINCT x AS \"xrefMeSH\", 'D' || (row_id % 40) AS disease_id, CAST(row_id % 100 AS VARCHAR) AS \"pubmedId\", 'CTD' AS source_database FROM st")
def src_ctd_exposure_disease(s, d):
    return src.ctd_exposure(_events(s, d))["exposure_linked_to_disease"]


@query(f"WITH {_EVENTS}, {_STRESS} SELECT DISTINCT x AS \"xrefMeSH\", gid AS \"xrefNcbiGene\", trim(gs) AS \"geneSymbol\", CAST(row_id % 100 AS VARCHAR) AS \"pubmedId\", 'CTD' AS source_database FROM st JOIN ev USING (row_id) WHERE row_id % 6 <> 0 AND gid <> ''")
def src_ctd_exposure_gene(s, d):
    return src.ctd_exposure(_events(s, d))["exposure_interacts_with_gene"]


@query(f"WITH {_EVENTS}, {_STRESS} SELECT DISTINCT x AS \"xrefMeSH\", 'GO:' || (row_id % 30) AS \"xrefGeneOntology\", CAST(row_id % 100 AS VARCHAR) AS \"pubmedId\", 'CTD' AS source_database FROM st WHERE (row_id % 30) % 3 = 1")
def src_ctd_exposure_process(s, d):
    go = s.range(30).select(F.concat(F.lit("GO:"), "id").alias("GOTermID"), F.element_at(F.array(F.lit("Molecular Function"), F.lit("Biological Process"), F.lit("Cellular Component")), (F.col("id") % 3 + 1).cast("int")).alias("Ontology"))
    return src.ctd_exposure(_events(s, d), src.go_namespaces(go))["exposure_interacts_with_biological_process"]


@query("""WITH e AS (SELECT DISTINCT CAST(1 + o_orderkey % 500 AS VARCHAR) AS cid, 'C' || (o_custkey % 60) AS u FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 1), t AS (SELECT 'C' || (c_custkey % 60) AS u, arg_min('M' || c_custkey, c_custkey) AS m FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1)
SELECT DISTINCT cid AS pubchem_cid, m AS meddra_id, 'SIDER' AS source_database FROM e JOIN t USING (u)""")
def src_sider(s, d):
    k = F.col("o_orderkey")
    kind = lambda c: F.when(c, "LLT").otherwise("PT").alias("concept_type")
    flat = F.when(k % 10 == 1, "bad").otherwise(F.concat(F.lit("cid1"), F.lpad((1 + k % 500).cast("string"), 8, "0")))
    e = table(s, d, "orders").select(flat.alias("stitch_flat"), F.lit("x").alias("stitch_stereo"), F.lit("u").alias("umls_label"), kind(k % 3 == 0), F.concat(F.lit(" C"), (F.col("o_custkey") % 60).cast("string")).alias("umls_meddra"), F.lit("n").alias("name"))
    c = F.col("c_custkey")
    t = table(s, d, "customer").select(F.concat(F.lit("C"), (c % 60).cast("string"), F.lit(" ")).alias("umls_cui"), kind(c % 4 == 0), F.concat(F.lit("M"), c.cast("string")).alias("meddra_id"), F.lit("n").alias("name"), c.alias("_ord"))
    return src.sider(e, t)["chemical_causes_effect"]


@query("""WITH m AS (SELECT l_suppkey AS sup, l_partkey % 90 AS p, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 90 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn, l_returnflag AS f FROM lineitem), i AS (SELECT 'P' || (p_partkey % 90) AS u, min(CAST(p_partkey AS VARCHAR)) AS g FROM part WHERE p_size > 5 GROUP BY 1)
SELECT DISTINCT 'DB' || sup AS drugbank_id, g AS ncbi_gene_id, 'BindingDB' AS source_database FROM m JOIN i ON u = 'P' || p WHERE rn = 1 AND f <> 'R' AND sup % 10 <> 3""")
def src_bindingdb(s, d):
    li = table(s, d, "lineitem")
    sup = F.col("l_suppkey")
    m = li.select(F.when(sup % 10 == 3, F.concat(F.lit("null"), F.lit(" "))).otherwise(F.concat(F.lit("DB"), sup.cast("string"))).alias("drugbank_id"), sup, F.concat(F.lit("P"), (F.col("l_partkey") % 90).cast("string")).alias("uniprot_id"), F.when(F.col("l_returnflag") == "R", "Mouse").otherwise("homo sapiens (human)").alias("organism"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("_ord"))
    ids = table(s, d, "part").select(F.concat(F.lit("P"), (F.col("p_partkey") % 90).cast("string")).alias("uniprot_id"), F.when(F.col("p_size") > 5, F.col("p_partkey").cast("string")).otherwise("-").alias("ncbi_gene_id"))
    return src.bindingdb(m, ids)["drug_binds_gene"]


_DRUGS = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chemical_id ORDER BY row_id) AS rn FROM chemical_nodes WHERE chemical_id IS NOT NULL) WHERE rn = 1)"


def _drugs(s, d):
    t = keep_first(table(s, d, "chemical_nodes").where("chemical_id is not null"), ["chemical_id"], ["row_id"])
    ident = lambda v, p: F.struct(v.alias("_VALUE"), F.lit(p).alias("_primary"))
    null = lambda x: F.lit(None).cast(x)
    pair = lambda a, b, k, v: F.struct(F.lit(k).alias(a), v.alias(b))
    actor = lambda g, u: F.struct(F.struct(u.alias("_id"), g.alias("gene-name")).alias("polypeptide"))
    k = F.col("row_id").cast("string")
    return t.select(
        F.when(F.col("row_id") % 13 != 0, "small molecule").alias("_type"), F.array(ident(F.lit("old"), None), ident(F.concat(F.lit(" "), "chemical_id"), "true")).alias("drugbank-id"), F.concat("chemical_name", F.lit("\nx")).alias("name"), null("string").alias("description"), F.col("cas_number").alias("cas-number"), F.struct(F.array(F.lit("approved"), F.lit("old")).alias("group")).alias("groups"),
        *[null("string").alias(c) for c in ("indication", "pharmacodynamics", "mechanism-of-action", "toxicity", "half-life", "state")], F.struct(F.array(F.struct(F.lit("cat").alias("category"))).alias("category")).alias("categories"),
        F.struct(F.array(pair("kind", "value", "InChIKey", F.lit("first")), pair("kind", "value", "InChIKey", F.col("inchikey"))).alias("property")).alias("calculated-properties"), F.struct(F.array(pair("resource", "identifier", "PubChem Compound", F.col("pubchem_cid")), pair("resource", "identifier", "ChEBI", F.lit(" "))).alias("external-identifier")).alias("external-identifiers"),
        F.struct(F.array(actor(F.concat(F.lit("G"), k), F.concat(F.lit("P"), k)), actor(null("string"), null("string"))).alias("target")).alias("targets"), F.struct(F.array(actor(F.lit(""), F.concat(F.lit("E"), k))).alias("enzyme")).alias("enzymes"), null(f"struct<carrier:{src.ACTORS}>").alias("carriers"), null(f"struct<transporter:{src.ACTORS}>").alias("transporters"))


@query(f"WITH {_DRUGS} SELECT chemical_id AS drugbank_id, coalesce(chemical_name || ' x', '') AS drug_name, 'small molecule' AS \"drugType\", 'approved; old' AS \"drugGroups\", 'cat' AS \"drugCategories\", coalesce({_line('inchikey')}, '') AS inchikey, coalesce({_line('cas_number')}, '') AS cas_number, coalesce({_line('pubchem_cid')}, '') AS pubchem_cid, '' AS chebi_id, 'DrugBank' AS source_database FROM t WHERE row_id % 13 <> 0 AND ({_strip('coalesce(cas_number, chr(32))')} <> '' OR {_strip('coalesce(pubchem_cid, chr(32))')} <> '')")
def src_drugbank(s, d):
    return src.drugbank(_drugs(s, d))["drugs"].select("drugbank_id", "drug_name", "drugType", "drugGroups", "drugCategories", "inchikey", "cas_number", "pubchem_cid", "chebi_id", "source_database")


@query(f"WITH {_DRUGS} SELECT chemical_id AS drugbank_id, 'G' || row_id AS gene_symbol, 'P' || row_id AS uniprot_id, 'target' AS interaction_type, 'DrugBank' AS source_database FROM t WHERE row_id % 13 <> 0 UNION ALL SELECT chemical_id, '', 'E' || row_id, 'enzyme', 'DrugBank' FROM t WHERE row_id % 13 <> 0")
def src_drugbank_edges(s, d):
    return src.drugbank(_drugs(s, d))["drug_gene_edges"]


@query(f"WITH {_DRUGS} SELECT chemical_id AS drugbank_id, chemical_name AS drug_name, cas_number, pubchem_cid, '' AS smiles, 'DrugBank' AS source_database FROM t WHERE {_strip('coalesce(cas_number, chr(32))')} <> '' OR {_strip('coalesce(pubchem_cid, chr(32))')} <> ''")
def src_drugbank_links(s, d):
    t = table(s, d, "chemical_nodes").where("chemical_id is not null").select(F.col("chemical_id").alias("DrugBank ID"), F.col("chemical_name").alias("Name"), F.col("cas_number").alias("CAS Number"), F.col("pubchem_cid").alias("PubChem Compound ID"), F.col("row_id").alias("_ord"))
    return src.drugbank_links(t)["drugs"].select("drugbank_id", "drug_name", "cas_number", "pubchem_cid", "smiles", "source_database")


_KINDS = ["DRUGBANK_ID", "CHEBI", "PUBCHEM_CID", "MESH_DESCRIPTOR_UI", "UMLSCUI", "OTHER"]


def _central(s, d):
    c, o, k = table(s, d, "customer"), table(s, d, "orders"), F.col("o_orderkey")
    txt = lambda v: F.lit(v)
    st = c.select(F.col("c_custkey").alias("id"), F.lit("cas").alias("cas_reg_no"), F.col("c_name").alias("name"), txt("k").alias("inchikey"), txt("i").alias("inchi"), txt("s").alias("smiles"), F.col("c_acctbal").alias("cd_molweight"), txt("f").alias("cd_formula"), F.lit(0.5).alias("clogp"), F.lit(1.5).alias("tpsa"), F.lit(0).alias("lipinski"))
    ids = o.select(F.col("o_custkey").alias("struct_id"), F.element_at(F.array(*map(F.lit, _KINDS)), (k % 6 + 1).cast("int")).alias("id_type"), F.concat(F.lit("x"), k.cast("string")).alias("identifier"))
    pc = o.select(F.when(k % 9 != 0, F.col("o_custkey")).alias("struct_id"), F.when(k % 7 != 0, F.concat(F.lit("N"), (k % 30).cast("string"))).alias("class_code"), F.when(k % 5 != 0, F.concat(F.lit("class "), (k % 30).cast("string"))).alias("name"), F.when(k % 4 != 0, "FDA").alias("source"))
    om = o.select(F.col("o_custkey").alias("struct_id"), F.concat(F.lit("C"), (k % 50).cast("string")).alias("umls_cui"), F.when(k % 3 == 0, "contraindication").otherwise("indication").alias("relationship_name"))
    fa = o.select(F.col("o_custkey").alias("struct_id"), k.cast("string").alias("meddra_code"), txt("n").alias("meddra_name"), F.when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("llr"), F.lit(90000.0).alias("llr_threshold"), (k % 8).alias("drug_ae"))
    return src.drugcentral(st, ids, pc, om, fa, ["C7", "C12", "C49"], 120000.0)


@query("""WITH i AS (SELECT o_custkey, o_orderkey % 6 AS t, max('x' || o_orderkey) AS x FROM orders GROUP BY ALL) SELECT c_custkey AS struct_id, c_name AS drug_name, c_acctbal AS molecular_weight, a.x AS drugbank_id, b.x AS chebi_id, p.x AS pubchem_cid, m.x AS mesh_id, u.x AS umls_cui, 'drugcentral' AS source_database FROM customer
LEFT JOIN i a ON a.o_custkey = c_custkey AND a.t = 0 LEFT JOIN i b ON b.o_custkey = c_custkey AND b.t = 1 LEFT JOIN i p ON p.o_custkey = c_custkey AND p.t = 2 LEFT JOIN i m ON m.o_custkey = c_custkey AND m.t = 3 LEFT JOIN i u ON u.o_custkey = c_custkey AND u.t = 4""")
def src_drugcentral(s, d):
    return _central(s, d)["drugs"].select("struct_id", "drug_name", "molecular_weight", "drugbank_id", "chebi_id", "pubchem_cid", "mesh_id", "umls_cui", "source_database")


@query("SELECT DISTINCT CASE WHEN o_orderkey % 4 <> 0 THEN 'FDA' ELSE 'DC' END || ':N' || (o_orderkey % 30) AS pharma_class_id, 'class ' || (o_orderkey % 30) AS pharma_class_name, 'N' || (o_orderkey % 30) AS pharma_class_code, 'drugcentral' AS source_database FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0")
def src_drugcentral_classes(s, d):
    return _central(s, d)["pharmacologic_classes"]


@query("SELECT DISTINCT o_custkey AS struct_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'FDA' ELSE 'DC' END || ':N' || (o_orderkey % 30) AS pharma_class_id, 'drugcentral' AS source_database FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0")
def src_drugcentral_members(s, d):
    return _central(s, d)["drug_in_class"]


@query("SELECT DISTINCT o_custkey AS struct_id, 'C' || (o_orderkey % 50) AS disease_id, 'indication' AS indication, 'drugcentral' AS source_database FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 50 IN (7, 12, 49)")
def src_drugcentral_indications(s, d):
    return _central(s, d)["drug_treats_disease"]


@query("SELECT o_custkey AS struct_id, CAST(o_orderkey AS VARCHAR) AS adverse_effect_id, 'n' AS adverse_effect_name, o_totalprice AS llr, o_orderkey % 8 AS drug_ae, 'drugcentral' AS source_database FROM orders WHERE o_totalprice > 120000 AND o_totalprice > 90000 AND o_orderkey % 8 >= 3 AND o_orderkey % 17 <> 0")
def src_drugcentral_effects(s, d):
    return _central(s, d)["chemical_causes_effect"]


def _aop(s, d):
    p = table(s, d, "part").select((F.col("p_partkey") % 300).alias("entrez"), F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("path_id"), F.concat(F.lit(" <i>"), "p_name", F.lit("</i> - Homo sapiens (human)")).alias("path_name"), F.col("p_brand").alias("ext_source"), F.when(F.col("p_partkey") % 5 == 0, 10090).otherwise(9606).alias("tax_id"))
    return src.aopdb(p, table(s, d, "region"))


@query("SELECT p_name AS path_name, string_agg(DISTINCT 'p' || p_size, ',' ORDER BY 'p' || p_size) AS path_id, 'AOPDB - ' || string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS ext_source, regexp_replace(lower(p_name), '[^a-z0-9_.:-]', '_', 'g') AS path_iri, 'AOPDB' AS source_database FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_name")
def src_aopdb(s, d):
    return _aop(s, d)["pathways"]


@query("SELECT DISTINCT p_partkey % 300 AS entrez, 'p' || p_size AS path_id, p_name AS path_name, 'AOPDB' AS source_database FROM part WHERE p_partkey % 5 <> 0")
def src_aopdb_genes(s, d):
    return _aop(s, d)["gene_pathway_relationships"]


# Result pages and articles

def _items(s, d):
    e, k = table(s, d, "graph_edges"), F.col("edge_id")
    voc = F.array(F.lit("MSH_unknown"), F.concat(F.when(k % 2 == 0, "MESH_D").otherwise("mesh_D"), (k % 20).cast("string")), F.lit("MESH_late"), F.concat(F.lit("DO_"), (k % 30).cast("string")), F.lit("OMIM_"), F.lit("none"))
    gid = k % 700
    return e.where("start_id is not null and end_id is not null").select(
        gid.alias("geneNcbiID"), F.concat(F.lit("S"), gid.cast("string")).alias("symbolOfGene"), F.when(gid % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), gid.cast("string")), F.lit("x"))).alias("geneEnsemblIDs"), F.lit(None).cast("array<string>").alias("geneProteinStrIDs"), F.lit(0.5).alias("genepLI"), F.lit(0.25).alias("geneDSI"), F.lit(None).cast("double").alias("geneDPI"),
        F.concat(F.lit("C"), (k % 60).cast("string")).alias("diseaseUMLSCUI"), F.lit("n").alias("diseaseName"), F.lit("disease").alias("diseaseType"), F.array(F.lit("a"), F.lit("b")).alias("diseaseClasses_MSH"), F.array().cast("array<string>").alias("diseaseClasses_UMLS_ST"), ((k % 100) / 100).alias("score"), F.lit(1.0).alias("ei"), (k % 9).alias("numPMIDs"), voc.alias("diseaseVocabularies"))


@query("SELECT * EXCLUDE (v, w) FROM (SELECT DISTINCT CAST(edge_id % 700 AS VARCHAR) AS \"geneId\", 'C' || (edge_id % 60) AS \"diseaseId\", (edge_id % 100) / 100 AS \"gdaScore\", 1.0::DOUBLE AS \"evidenceIndex\", edge_id % 9 AS \"numberOfPublications\", 'DisGeNET' AS source_database, edge_id % 20 AS v, edge_id % 30 AS w FROM graph_edges WHERE start_id IS NOT NULL AND end_id IS NOT NULL)")
def src_disgenet(s, d):
    return src.disgenet(_items(s, d))["gene_disease_associations"].drop("numberOfSnps")


@query("SELECT DISTINCT CAST(g AS VARCHAR) AS \"geneId\", 'S' || g AS \"geneSymbol\", CASE WHEN g % 3 <> 0 THEN 'E' || g END AS \"ensemblId\", 0.5::DOUBLE AS \"pLI\", 0.25::DOUBLE AS \"DSI\", 'DisGeNET' AS source_database FROM (SELECT edge_id % 700 AS g FROM graph_edges WHERE start_id IS NOT NULL AND end_id IS NOT NULL)")
def src_disgenet_genes(s, d):
    return src.disgenet(_items(s, d))["genes"].drop("proteinId", "DPI")


@query("SELECT \"diseaseId\", \"MSH\", \"DO\", '' AS \"OMIM\", \"diseaseClass\", source_database FROM (SELECT 'C' || (edge_id % 60) AS \"diseaseId\", min('D' || (edge_id % 20)) AS \"MSH\", 'DOID:' || min(CAST(edge_id % 30 AS VARCHAR)) AS \"DO\", 'a; b' AS \"diseaseClass\", 'DisGeNET' AS source_database FROM graph_edges WHERE start_id IS NOT NULL AND end_id IS NOT NULL GROUP BY 1)")
def src_disgenet_diseases(s, d):
    return src.disgenet(_items(s, d))["diseases"].select("diseaseId", "MSH", "DO", "OMIM", "diseaseClass", "source_database")


def _articles(s, d):
    """Entities by MeSH id; every third id belongs to two diseases."""
    t = table(s, d, "pmid_mesh").select(F.regexp_replace(F.upper(F.trim("mesh_id")), "^MESH:", "").alias("mesh_id"), F.col("pmid").alias("doc"), "entity_kind")
    of = lambda kind: t.where(F.col("entity_kind") == kind).where("mesh_id is not null").select("mesh_id").distinct()
    dis = of("disease").select(F.explode(F.when(F.length("mesh_id") % 2 == 0, F.array(F.concat(F.lit("DOID:"), "mesh_id"))).otherwise(F.array(F.concat(F.lit("DOID:"), "mesh_id"), F.concat(F.lit("DOID:x"), "mesh_id")))).alias("doid_code"), F.concat(F.lit("MESH:"), "mesh_id").alias("mesh_id"))
    return src.medline(t.select("mesh_id", "doc"), dis, of("symptom"), of("anatomy").select(F.concat(F.lit("UB:"), "mesh_id").alias("uberon_id"), "mesh_id"))


_ART = """doc AS (SELECT DISTINCT pmid AS doc, regexp_replace(upper(trim(mesh_id)), '^MESH:', '') AS m FROM pmid_mesh WHERE mesh_id IS NOT NULL AND pmid IS NOT NULL), kind AS (SELECT DISTINCT regexp_replace(upper(trim(mesh_id)), '^MESH:', '') AS m, entity_kind AS k FROM pmid_mesh WHERE mesh_id IS NOT NULL),
dis AS (SELECT m, unnest(CASE WHEN length(m) % 2 = 0 THEN ['DOID:' || m] ELSE ['DOID:' || m, 'DOID:x' || m] END) AS code FROM kind WHERE k = 'disease'), d AS (SELECT doc, m, code FROM doc JOIN dis USING (m)), s AS (SELECT doc, m FROM doc JOIN kind USING (m) WHERE k = 'symptom'), a AS (SELECT doc, m FROM doc JOIN kind USING (m) WHERE k = 'anatomy'),
nd AS (SELECT code, count(*) AS n FROM d GROUP BY 1)"""


def _art(target: str, name: str, value: str, more: str) -> str:
    return f"""WITH {_ART}, corp AS (SELECT count(*) AS corpus FROM (SELECT doc FROM d INTERSECT SELECT doc FROM {target})), nt AS (SELECT m AS t, count(*) AS n FROM {target} GROUP BY 1), pr AS (SELECT code, d.m AS dm, x.m AS t, count(*) AS c FROM d JOIN {target} x USING (doc) GROUP BY ALL),
st AS (SELECT *, nd.n - c AS b1, nt.n - c AS c1, greatest(corpus - nd.n - nt.n + c, 0) AS dd, nd.n AS ns, nt.n AS nn FROM pr JOIN nd USING (code) JOIN nt USING (t), corp)
SELECT code AS doid_code, {value} AS {name}, c AS cooccurrence, round(c * corpus / (ns * nn), 4) AS enrichment, CASE WHEN b1 * c1 = 0 THEN 'inf'::DOUBLE ELSE round(c * dd / (b1 * c1), 6) END AS odds_ratio, dm AS source_mesh{more}, 'MEDLINE' AS source_database FROM st"""


@query(_art("s", "mesh_id", "t", ""))
def src_medline_symptoms(s, d):
    return _articles(s, d)["disease_symptom_cooccurrence"].drop("p_fisher")


@query(_art("a", "uberon_id", "'UB:' || t", ", t AS target_mesh"))
def src_medline_anatomy(s, d):
    return _articles(s, d)["disease_anatomy_cooccurrence"].drop("p_fisher")


@query(f"""WITH {_terms('MONDO')}, live AS (SELECT 'DOID:' || id[7:] AS doid, name FROM term WHERE NOT is_obsolete), often AS (SELECT m FROM (SELECT lpad(CAST(o_custkey % 400 + 1000 AS VARCHAR), 7, '0') AS m, o_orderkey % 97 AS st FROM orders) GROUP BY m HAVING count(DISTINCT st) > 20),
base AS (SELECT DISTINCT doid FROM (SELECT 'DOID:' || id[7:] AS doid FROM term WHERE row_id % 10 = 0 UNION ALL SELECT 'DOID:' || term.doid FROM often JOIN term ON id = 'MONDO:' || m WHERE NOT is_obsolete AND term.doid IS NOT NULL)), b AS (SELECT doid, name FROM base JOIN live USING (doid)), c AS (SELECT 'DOID:' || id[7:] AS doid, 'cancer' AS name FROM term WHERE row_id % 35 = 0)
SELECT doid, name FROM c UNION ALL SELECT doid, name FROM b WHERE doid NOT IN (SELECT doid FROM c)""")
def src_slim_terms(s, d):
    mo = terms(s, d, "MONDO")
    do = mo.withColumn("id", F.concat(F.lit("DOID:"), F.substring("id", 7, 99)))
    st = table(s, d, "orders").select(F.concat(F.lit("http://x/EFO_1, http://x/MONDO_"), F.lpad((F.col("o_custkey") % 400 + 1000).cast("string"), 7, "0")).alias("trait_uris"), (F.col("o_orderkey") % 97).cast("string").alias("study"))
    return src.slim_terms(do.where("row_id % 10 = 0").select(F.col("id").alias("doid"), "name"), do.where("row_id % 35 = 0").select(F.col("id").alias("doid"), F.lit("cancer").alias("name")), st, mo.withColumn("xref", F.filter("xref", lambda x: F.startswith(x, F.lit("DOID:")))), do)


# Readers and sinks: a table written in a format and read back

def _folder(s, name: str) -> str:
    return scratch_path(s, name)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def io_tsv(s, d):
    at = _folder(s, "tsv")
    export.write_tsv(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), at)
    return readers.delimited(s, at, ["c_custkey", "c_name", "c_mktsegment"], header=True)


@query("SELECT CAST(p_partkey AS VARCHAR) AS a, p_name AS b, true AS c_is_null FROM part")
def io_headerless_gz(s, d):
    """Two fields per line, blank-separated names quoted, read into three columns."""
    at = _folder(s, "gz")
    table(s, d, "part").select("p_partkey", "p_name").write.option("compression", "gzip").option("quoteAll", "true").option("sep", ";").csv(at)
    return readers.delimited(s, at, ["a", "b", "c"], sep=";", quote='"').select("a", "b", F.col("c").isNull().alias("c_is_null"))


@query("SELECT 'C' || o_custkey AS a, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS b, CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE 'x' END AS c FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 4 > 0")
def io_ragged(s, d):
    """Comment lines and lines of one field go, short ones are padded, long ones cut."""
    at, k = _folder(s, "ragged"), F.col("o_orderkey")
    more = F.element_at(F.array(F.lit(""), F.concat(F.lit("\t"), k.cast("string")), F.concat(F.lit("\t"), k.cast("string"), F.lit("\tx")), F.concat(F.lit("\t"), k.cast("string"), F.lit("\tx\ty\tz"))), (k % 4 + 1).cast("int"))
    table(s, d, "orders").select(F.concat(F.when(k % 5 == 0, "!").otherwise(""), F.lit("C"), F.col("o_custkey").cast("string"), more).alias("value")).write.text(at)
    return readers.ragged(s, at, ["a", "b", "c"], least=2, skip="!")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 3 > 0 THEN 'b' END AS b FROM orders WHERE o_orderkey % 3 < 2")
def io_well_formed(s, d):
    """Lines with too many fields are skipped, lines with too few are not."""
    at, k = _folder(s, "bad-lines"), F.col("o_orderkey")
    table(s, d, "orders").select(F.concat(k.cast("string"), F.element_at(F.array(F.lit(""), F.lit("\tb"), F.lit("\tb\tc")), (k % 3 + 1).cast("int"))).alias("value")).write.text(at)
    return readers.well_formed(s, at, ["a", "b"])


@query("SELECT count(*) AS n_lines, count(*) FILTER (o_orderkey % 3 <> 1) AS n_bad FROM orders")
def io_bad_rows(s, d):
    at, k = _folder(s, "bad-rows"), F.col("o_orderkey")
    table(s, d, "orders").select(F.concat(k.cast("string"), F.element_at(F.array(F.lit(""), F.lit("\tb"), F.lit("\tb\tc")), (k % 3 + 1).cast("int"))).alias("value")).write.text(at)
    return readers.count_bad_rows(s, at, 2)


@query(f"WITH {_terms('DOID')} SELECT id, trim(regexp_replace(name, '[^ -~]+', ' ', 'g')) AS name, namespace, is_obsolete, array_to_string(subset, '|') AS subset, array_to_string(list_transform(up, lambda x: x || ' ! parent'), '|') AS is_a, coalesce('MESH:' || regexp_replace(mesh_id, '[^A-Za-z0-9:]', '', 'g'), '') AS mesh FROM term")
def io_obo(s, d):
    """Terms written as stanzas, every other one with carriage returns."""
    at = _folder(s, "obo")
    # What cannot stand in a line is left out of the names and references.
    t = terms(s, d, "DOID").withColumn("name", F.coalesce(F.trim(F.regexp_replace("name", "[^ -~]+", " ")), F.lit(""))).withColumn("xref", F.transform("xref", lambda x: F.regexp_replace(x, "[^A-Za-z0-9:]", "")))
    nl = F.when(F.col("row_id") % 2 == 0, "\r\n").otherwise("\n")
    tag = lambda name, c: F.transform(c, lambda v: F.concat(F.lit(f"{name}: "), v))
    mesh = F.filter("xref", lambda x: F.startswith(x, F.lit("MESH:")))
    lines = F.concat(F.array(F.lit("[Term]"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("name: "), "name"), F.concat(F.lit("namespace: "), "namespace")), tag("subset", F.transform("subset", lambda x: F.concat(x, F.lit(" ! note")))), tag("xref", F.transform(mesh, lambda x: F.concat(x, F.lit(' "text"')))), tag("is_a", F.col("is_a")), F.when(F.col("is_obsolete"), F.array(F.lit("is_obsolete: true"))).otherwise(F.array().cast("array<string>")), F.array(F.lit(""), F.lit("[Typedef]"), F.lit("id: part_of"), F.lit("")))
    t.select(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, nl))).alias("value")).write.option("lineSep", "\n").text(at)
    o = obo_reader.terms(s, at)
    return o.select("id", "name", "namespace", "is_obsolete", F.array_join("subset", "|").alias("subset"), F.array_join("is_a", "|").alias("is_a"), F.array_join("xref", "|").alias("mesh"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def io_xml(s, d):
    at = _folder(s, "xml")
    table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.struct(F.col("c_name").alias("String")).alias("name"), F.struct(F.array("c_mktsegment").alias("segment")).alias("list")).write.format("xml").option("rowTag", "row").option("rootTag", "rows").save(at)
    x = readers.xml_rows(s, at, "row", "id string, name struct<String:string>, list struct<segment:array<string>>")
    return x.select("id", F.col("name.String").alias("name"), F.col("list.segment")[0].alias("segment"))


@query("SELECT r_name AS entity_id, CAST(n_nationkey AS VARCHAR) AS doc FROM nation JOIN region ON r_regionkey = n_regionkey")
def io_id_per_file(s, d):
    """One file of ids per region, named after it."""
    at = _folder(s, "ids")
    x = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(F.col("n_nationkey").cast("string")).alias("ids"))
    for r in x.collect():  # five regions
        write_small(s, f"{at}/{r.r_name.replace(' ', '%20')}.txt", "\n".join(r.ids) + "\n\n")
    return readers.id_per_file(s, f"{at}/*.txt").withColumn("entity_id", F.replace(F.replace("entity_id", F.lit("%2520"), F.lit(" ")), F.lit("%20"), F.lit(" ")))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT a.i, b.i AS j, round(sum(a.x * b.x), 6) AS score FROM v a JOIN v b USING (vec_id) GROUP BY ALL)
SELECT 'd' || i AS source_hgnc, 'd' || j AS target_hgnc, score AS erc_score, 'ERC' AS source_database FROM m WHERE i < j AND score >= 0.5""")
def io_wide_matrix(s, d):
    """The products of the embeddings' dimensions in a file with labels on both sides."""
    at = _folder(s, "matrix")
    cells = dimension_products(s, d).groupBy("i").pivot("j", list(range(64))).agg(F.first(F.round("score", 6)))
    cells.select(F.concat(F.lit("d"), "i").alias("label"), *[F.col(str(j)).alias(f"d{j}") for j in range(64)]).write.option("header", "true").csv(at)
    rows, labels = readers.wide_matrix(s, at)
    return src.rate_covariation(rows, labels, 0.5)["gene_covariation"]


@query("SELECT 'node' AS kind, node_type AS name, count(*) AS n, count(CASE WHEN trim(source_key) <> '' THEN 1 END) AS filled FROM graph_nodes WHERE id IS NOT NULL GROUP BY ALL UNION ALL SELECT 'edge', rel_type, count(*), count(props['score']) FROM graph_edges GROUP BY ALL")
def io_graph(s, d):
    """The graph written as one table per type, and read back by the files' names."""
    at = _folder(s, "graph")
    v = table(s, d, "graph_nodes").where("id is not null").select("id", "node_type", F.map_filter(F.create_map(F.lit("source"), F.array("source_key")), lambda _, x: F.coalesce(F.trim(x[0]) != "", F.lit(False))).alias("props"))
    e = table(s, d, "graph_edges")
    export.write_graph(v, e, at)
    out = None
    for kind, col in (("nodes", "source"), ("edges", "score")):
        for name, df in readers.typed_tables(s, at, kind).items():
            x = df.agg(F.lit(kind.removesuffix("s")).alias("kind"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count(col).alias("filled"))
            out = x if out is None else out.unionByName(x)
    return out


@query("SELECT node_type, count(*) AS n, sum(k)::BIGINT AS n_values FROM (SELECT a.id, a.node_type, count(DISTINCT b.source_key) AS k FROM (SELECT DISTINCT id, node_type FROM graph_nodes WHERE id IS NOT NULL) a LEFT JOIN graph_nodes b ON a.id = b.id GROUP BY ALL) GROUP BY node_type")
def io_rdf(s, d):
    """Nodes and edges written as individuals of an RDF/XML file, nodes read back as triples."""
    t = build.triple_nodes(readers.rdf_individuals(s, _rdf_file(s, d)))
    return t.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size(F.col("props")["source"]), F.lit(0))).alias("n_values"))


def _rdf_file(s, d) -> str:
    at, g = _folder(s, "rdf"), table(s, d, "graph_nodes").where("id is not null")
    v = g.groupBy("id", "node_type").agg(F.create_map(F.lit("source"), F.array_sort(F.collect_set("source_key"))).alias("props"))
    export.write_rdf(v, table(s, d, "graph_edges"), at, "http://ex.org/kg")
    return at


@query("SELECT rel_type, count(*) AS n FROM (SELECT DISTINCT rel_type, start_id, end_id FROM graph_edges WHERE start_id IN (SELECT id FROM graph_nodes) AND end_id IN (SELECT id FROM graph_nodes)) GROUP BY rel_type")
def io_rdf_edges(s, d):
    """The same file's links between individuals."""
    t = readers.rdf_individuals(s, _rdf_file(s, d))
    return gm.edge_counts(build.triple_edges(t).distinct())


@query("SELECT 'genes' AS table_name, 0::BIGINT AS n_rows, 9 + 1 AS n_columns UNION ALL SELECT 'symptom_nodes', 0, 3")
def io_empty_outputs(s, d):
    """What a source gives whose landing folder is empty: its tables, typed, without rows."""
    done, _ = registry.run(s, _folder(s, "landing"), {"ncbigene": {"enabled": True}, "mesh": {"enabled": True}})
    out = [(k, df.count(), len(df.columns)) for made in done.values() for k, df in made.items()]
    return s.createDataFrame(out, "table_name string, n_rows long, n_columns int")


@query("SELECT s, count(*) AS n FROM (SELECT id AS s FROM graph_nodes WHERE source_key IS NOT NULL GROUP BY id, source_key) GROUP BY s")
def io_ntriples(s, d):
    """Literal triples as lines of N-Triples; how many lines each subject has."""
    at, b = _folder(s, "nt"), "http://ex.org/kg#"
    t = table(s, d, "graph_nodes").where("source_key is not null and id is not null").select(F.concat(F.lit(b), "id").alias("s"), F.lit(b + "source").alias("p"), F.col("source_key").alias("o"), F.lit(True).alias("o_is_literal"))
    export.write_lines(export.ntriples(t), at)
    return s.read.text(at).select(F.regexp_extract("value", r"^<http://ex.org/kg#([^>]*)> <http://ex.org/kg#source> \".*\" \.$", 1).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))


# The catalog of sources as it is shown

def _catalog(s, d) -> DataFrame:
    from weftline.graph import catalog_view as cv

    k = F.col("c_custkey")
    of = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    rows = table(s, d, "customer").select(
        F.when(k % 50 != 0, F.concat(F.lit(" "), k.cast("string"))).alias("ID"), F.col("c_name").alias("Label"), of(["Direct", "Hetionet", "New", "other"], k % 4).alias("Integration Path"), of(["Yes", "No", "yes"], k % 3).alias("Active"), of(["Implemented", "To-do", "TBD", "", "Dropped"], k % 5).alias("Status"),
        F.lit("").alias("Latest Version"), F.concat(F.lit("Gene, Type"), (k % 8).cast("string"), F.lit(", unknown")).alias("Biomedical Entities (Node types)"), of(["binds", ""], k % 2).alias("Biomedical Relationships (Edge types)"))
    return cv.records(rows, {"Gene": "nt_gene", **{f"Type{i}": f"nt_{i}" for i in range(8)}}, {"binds": "et_binds"})


_CAT = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, (['Direct', 'Hetionet', 'New', 'other'])[c_custkey % 4 + 1] AS integration, c_custkey % 3 = 0 AS active, (['Implemented', 'To-do', 'TBD', 'N/A', 'Dropped'])[c_custkey % 5 + 1] AS status, ['nt_gene', 'nt_' || (c_custkey % 8)] AS nodes, CASE WHEN c_custkey % 2 = 0 THEN ['et_binds'] ELSE [] END AS edges FROM customer WHERE c_custkey % 50 <> 0),
vis AS (SELECT *, integration = 'Direct' AND status <> 'TBD' AS v FROM c)"""


def _visible() -> Column:
    from weftline.graph.catalog_view import is_visible

    return is_visible(["Direct"], hidden_statuses=["TBD"])


@query(f"WITH {_CAT} SELECT id, integration, active, status, 'N/A' AS version, array_to_string(nodes, '|') AS nodes, array_to_string(edges, '|') AS edges FROM c")
def catalog_records(s, d):
    return _catalog(s, d).select("id", "integration", "active", "status", "version", F.array_join("nodes", "|").alias("nodes"), F.array_join("edges", "|").alias("edges"))


@query(f"""WITH {_CAT} SELECT count(*) FILTER (integration = 'Direct') AS "Direct", count(*) FILTER (integration = 'Hetionet') AS "Hetionet", count(*) FILTER (integration = 'New') AS "New", count(*) FILTER (active) AS active_yes, count(*) FILTER (NOT active) AS active_no, count(*) FILTER (status = 'Implemented') AS "status_Implemented", count(*) FILTER (status = 'To-do') AS "status_To-do", count(*) FILTER (status = 'TBD') AS "status_TBD", count(*) FILTER (status NOT IN ('Implemented', 'To-do', 'TBD')) AS status_obsolete FROM c""")
def catalog_facets(s, d):
    from weftline.graph.catalog_view import facet_counts

    return facet_counts(_catalog(s, d), ["Direct", "Hetionet", "New"])


@query(f"WITH {_CAT}, l AS (SELECT id AS source, CAST(k + 1 AS VARCHAR) AS target FROM c UNION ALL SELECT id, 'nt_gene' FROM c) SELECT source, target FROM l WHERE source NOT IN (SELECT id FROM vis WHERE NOT v) AND target NOT IN (SELECT id FROM vis WHERE NOT v)")
def catalog_links(s, d):
    from weftline.graph.catalog_view import visible_links

    c = _catalog(s, d)
    links = c.select(F.col("id").alias("source"), F.explode(F.array((F.col("id").cast("long") + 1).cast("string"), F.lit("nt_gene"))).alias("target"))
    return visible_links(links, c, _visible())


@query(f"WITH {_CAT}, x AS (SELECT unnest(list_distinct(list_concat(nodes, edges))) AS type, v AND active AS on_ FROM vis) SELECT type FROM x GROUP BY type HAVING NOT bool_or(on_)")
def catalog_inactive(s, d):
    from weftline.graph.catalog_view import inactive_types

    c = _catalog(s, d)
    return inactive_types(c, _visible())


@query("SELECT 'declared' AS kind, count(*) AS n FROM (SELECT DISTINCT rel_type FROM graph_edges WHERE source_database = 'CTD') UNION ALL SELECT 'missing', count(*) FROM (SELECT DISTINCT rel_type FROM graph_edges EXCEPT SELECT DISTINCT rel_type FROM graph_edges WHERE source_database = 'CTD')")
def missing_types(s, d):
    e = table(s, d, "graph_edges")
    some = e.where("source_database = 'CTD'")
    missing = gm.missing_types(e, some, "rel_type").agg(F.lit("missing").alias("kind"), F.count(F.lit(1)).alias("n"))
    return some.agg(F.lit("declared").alias("kind"), F.countDistinct("rel_type").alias("n")).unionByName(missing)
