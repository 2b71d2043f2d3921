"""One function per source: raw DataFrames in, named tables out.

All are pure DataFrame -> DataFrame plans without UDFs. ``_ord`` columns, where
a source needs one, give the order of rows in the file (rows.with_ordinal or
readers.ragged(with_ordinal=True)): choosing the first row per key depends on it.
Missing inputs give missing outputs (registry.run makes empty tables of them);
columns that a plan doesn't use are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import nested as n
from weftline.functions import text as x
from weftline.operators.rows import keep_first, lookup, resolve_two
from weftline.sources.readers import ge, gt


def _from(df: DataFrame, name: str, column: str = "source_database") -> DataFrame:
    return df.withColumn(column, F.lit(name))


def _order(df: DataFrame) -> list:
    """The file order if there is one, else all columns: still a stable choice."""
    return ["_ord"] if "_ord" in df.columns else [F.col(c) for c in df.columns if not c.startswith("_")]


# genes and interactions

#: Symbols of entries that are not a gene of their own.
SECONDARY_SYMBOL = r"^(?:LOC\d+|LINC\d+)$|-(?:AS|OT|IT)\d+$"


def ncbigene(gene_info: DataFrame, taxon: str = "9606") -> dict[str, DataFrame]:
    """gene_info has tax_id and the columns below. ``xrefs`` is a map; widen() makes columns."""
    keep = ["GeneID", "Symbol", "Synonyms", "dbXrefs", "chromosome", "description", "type_of_gene", "Full_name_from_nomenclature_authority"]
    secondary = F.coalesce(F.col("Symbol").rlike(SECONDARY_SYMBOL), F.lit(False)) | x.contains_ci("description", "readthrough") | x.contains_ci("description", "uncharacterized")
    g = gene_info.where(F.col("tax_id") == taxon).select(*keep).withColumn("xrefs", n.key_values("dbXrefs"))
    # Entries that are not a gene of their own lose their Ensembl id.
    g = g.withColumn("xrefs", F.when(secondary, F.map_filter("xrefs", lambda k, _: k != "Ensembl")).otherwise(F.col("xrefs")))
    return {"genes": _from(g, "NCBIGene")}


def widen(df: DataFrame, map_column: str, prefix: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Columns for the keys of a map: those given, or all there are, sorted (found by one
    aggregate; for maps whose keys are names of sources, a bounded few)."""
    if keys is None:
        found = df.select(F.explode(F.map_keys(map_column)).alias("k")).distinct()
        keys = sorted(r.k for r in found.collect())
    return df.select(*[c for c in df.columns if c != map_column], *[F.col(map_column)[k].alias(prefix + k) for k in keys])


#: Alias sources that name NCBI genes, best first, and what others that do look like.
LOOSE_ALIAS = "hgnc_entrez|geneid|dr_geneid"
ALIAS_PRIORITY = ("Ensembl_HGNC_entrez_id", "UniProt_DR_GeneID", "KEGG_GENEID")


def string_ppi(links: DataFrame, aliases: DataFrame, min_score: int = 700, taxon: str = "9606") -> dict[str, DataFrame]:
    """links(protein1, protein2, combined_score), aliases(string_protein_id, alias, source)."""
    bare = lambda c: F.regexp_replace(c, rf"^{taxon}\.", "")
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(ALIAS_PRIORITY)], F.lit(99))
    # Only if no source has a known name, any that looks like one: whether there is one is an aggregate of one row.
    known = F.coalesce(F.col("source").isin(list(ALIAS_PRIORITY)), F.lit(False))
    loose = F.coalesce(F.lower("source").rlike(LOOSE_ALIAS), F.lit(False))
    some = F.broadcast(aliases.agg(F.coalesce(F.bool_or(known), F.lit(False)).alias("_named")))
    pool = aliases.withColumn("_known", known).withColumn("_loose", loose).where("_known or _loose").join(some, F.col("_known") == F.col("_named"))
    genes = keep_first(pool.select(bare("string_protein_id").alias("protein"), "alias", rank.alias("rank")), ["protein"], ["rank", "alias"])
    scored = links.where(F.col("combined_score").cast("long") >= min_score).select(bare("protein1").alias("p1"), bare("protein2").alias("p2"), F.col("combined_score").cast("long").alias("combined_score"), *(["_ord"] if "_ord" in links.columns else []))
    e = resolve_two(scored, genes, "p1", "p2", "protein", "alias", ("gene_id_1", "gene_id_2"))
    out = keep_first(e, ["gene_id_1", "gene_id_2"], _order(e)).select("gene_id_1", "gene_id_2", "combined_score")
    return {"gene_interactions": _from(out, "STRING")}


def bgee(calls: DataFrame, min_score: float = 90.0, tissues: Sequence[str] = ()) -> dict[str, DataFrame]:
    """calls: gene_id, anatomical_entity_id, expression, call_quality, fdr, expression_score, expression_rank."""
    d = lambda c: F.col(c).try_cast("double")
    c = calls.where((F.col("expression") == "present") & F.startswith("anatomical_entity_id", F.lit("UBERON:")))
    if tissues:
        c = c.where(F.col("anatomical_entity_id").isin(list(tissues)))
    c = c.where(gt(d("expression_score"), min_score))
    out = c.select(F.col("anatomical_entity_id").alias("uberon_id"), F.col("gene_id").alias("ensembl_gene_id"), F.col("expression").alias("expression_call"), "call_quality", d("fdr").alias("fdr"), d("expression_score").alias("expression_score"), d("expression_rank").alias("expression_rank"), F.lit(True).alias("unbiased"))
    return {"anatomy_expresses_gene": _from(out, "Bgee", "sourceDatabase")}


def collectri(interactions: DataFrame) -> dict[str, DataFrame]:
    """interactions: source_genesymbol, target_genesymbol and six flags."""
    flags = ["is_directed", "is_stimulation", "is_inhibition", "consensus_direction", "consensus_stimulation", "consensus_inhibition"]
    i = interactions.na.drop(subset=["source_genesymbol", "target_genesymbol"])
    tf = i.select(F.col("source_genesymbol").alias("tf_symbol")).distinct()
    e = i.select(F.col("source_genesymbol").alias("tf_symbol"), F.col("target_genesymbol").alias("target_gene"), *[F.col(f).cast("int").alias(f) for f in flags])
    return {"transcription_factors": _from(tf, "CollecTRI"), "tf_gene_interactions": _from(e, "CollecTRI")}


def dorothea(interactions: DataFrame, levels: Sequence[str] = ("A", "B", "C", "D")) -> dict[str, DataFrame]:
    """interactions: source, target, source_genesymbol, target_genesymbol, is_directed,
    is_stimulation, is_inhibition, curation_effort, dorothea_level (several joined by ;)."""
    i = interactions.where(n.overlaps(F.split("dorothea_level", ";"), list(levels)))
    tf = i.select(F.col("source_genesymbol").alias("tf_symbol")).where("tf_symbol is not null").distinct().withColumn("node_type", F.lit("TranscriptionFactor"))
    up, down = F.col("is_stimulation").cast("int") == 1, F.col("is_inhibition").cast("int") == 1
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    mode = F.when(up & ~down, "activation").when(down & ~up, "repression").when(up & down, "dual").otherwise("unknown")
    score = F.when(up & ~down, 1).when(down & ~up, -1).otherwise(0)
    e = i.na.drop(subset=["source_genesymbol", "target_genesymbol"]).select(
        F.col("source_genesymbol").alias("tf_symbol"), F.col("target_genesymbol").alias("target_gene"), F.col("source").alias("tf_uniprot"), F.col("target").alias("target_uniprot"), F.col("dorothea_level").alias("confidence"), "curation_effort",
        mode.alias("mode_of_regulation"), score.alias("mor_score"), "is_directed", F.lit("TRANSCRIPTION_FACTOR_INTERACTS_WITH_GENE").alias("relationship"))
    return {"transcription_factors": _from(tf, "DoRothEA"), "tf_gene_interactions": _from(e, "DoRothEA")}


#: Evidence codes of gene annotations, most reliable first.
EVIDENCE = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP", "HTP", "HDA", "HMP", "HGI", "HEP", "IBA", "IBD", "IKR", "IRD", "TAS", "IC", "ISS", "ISO", "ISA", "ISM", "IGC", "RCA", "NAS", "ND", "IEA")
NAMESPACES = ("biological_process", "molecular_function", "cellular_component")


def evidence_rank(c: str) -> Column:
    return F.coalesce(*[F.when(F.col(c) == e, i) for i, e in enumerate(EVIDENCE)], F.lit(len(EVIDENCE)))


def gene_ontology(obo: DataFrame, gaf: DataFrame, taxon: str = "9606") -> dict[str, DataFrame]:
    """obo as from obo.terms; gaf: DB, DB_Object_Symbol, Qualifier, GO_ID, Evidence_Code, Aspect, Taxon."""
    t = obo.where("not is_obsolete").select(F.col("id").alias("go_id"), F.coalesce("name", F.lit("")).alias("name"), x.definition_before_first_bracket(F.coalesce("def", F.lit(""))).alias("definition"), "namespace")
    out = {f"{ns}_nodes": _from(t.where(F.col("namespace") == ns).drop("namespace"), "Gene Ontology") for ns in NAMESPACES}
    a = gaf.where(F.col("Taxon").contains(f"taxon:{taxon}") & (F.col("DB") == "UniProtKB") & ~F.coalesce(F.col("Qualifier").contains("NOT"), F.lit(False)))
    order = F.struct(evidence_rank("Evidence_Code"), *(["_ord"] if "_ord" in gaf.columns else ["Evidence_Code"]))
    for aspect, name in (("P", "gene_bp_associations"), ("F", "gene_mf_associations"), ("C", "gene_cc_associations")):
        best = a.where(F.col("Aspect") == aspect).groupBy(F.col("DB_Object_Symbol").alias("gene_symbol"), F.col("GO_ID").alias("go_id")).agg(F.min_by("Evidence_Code", order).alias("evidence"))
        out[name] = _from(best, "Gene Ontology")
    return out


def reactome(pathways: DataFrame, genes: DataFrame, species: str = "Homo sapiens") -> dict[str, DataFrame]:
    """pathways(reactome_id, pathway_name, species), genes(ncbi_gene_id, reactome_id, url, name, evidence_code, species)."""
    return {
        "pathways": _from(pathways.where(F.col("species") == species).select("reactome_id", "pathway_name", "species"), "Reactome"),
        "ncbi_gene_pathway_relationships": _from(genes.where(F.col("species") == species).select("ncbi_gene_id", "reactome_id", "evidence_code").distinct(), "Reactome"),
    }


def rate_covariation(rows: DataFrame, labels: Sequence[str], threshold: float = 117**0.5) -> dict[str, DataFrame]:
    """rows(i, scores array<double>) of a square matrix, labels by position: its strict
    upper triangle in long form, at or above the threshold."""
    names = rows.sparkSession.createDataFrame(list(enumerate(labels)), "k int, label string")
    e = rows.select("i", F.posexplode("scores").alias("j", "erc_score")).where((F.col("i") < F.col("j")) & ge("erc_score", threshold))
    e = e.join(names.select(F.col("k").alias("i"), F.col("label").alias("source_hgnc")), "i").join(names.select(F.col("k").alias("j"), F.col("label").alias("target_hgnc")), "j")
    e = e.where(~x.is_blank("source_hgnc") & ~x.is_blank("target_hgnc"))
    return {"gene_covariation": _from(e.select("source_hgnc", "target_hgnc", "erc_score"), "ERC")}


# diseases, phenotypes, anatomy

#: Subsets of terms that only group others.
GROUPING = ["non_grouping", "grouping_class", "upper_level", "non_informative"]


def in_scope(id_: Column, name: Column, scope: dict[str, list[str]], lists: dict[str, Column]) -> Column:
    """Whether a term matches any criterion of the scope: its id (ids), an element of a
    list (by the list's name) or a part of its name (terms); an empty scope passes all."""
    if not any(scope.values()):
        return F.lit(True)
    out = id_.isin(scope.get("ids", [])) if scope.get("ids") else F.lit(False)
    for k, xs in lists.items():
        out = out | n.overlaps(xs, scope.get(k, []))
    for t in scope.get("terms", []):
        out = out | x.contains_ci(name, t)
    return F.coalesce(out, F.lit(False))


def mondo(obo: DataFrame, scope: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """scope: ids, omim, umls, terms."""
    t = obo.where(F.startswith("id", F.lit("MONDO:")) & ~F.col("is_obsolete") & ~n.overlaps("subset", GROUPING))
    of = lambda p: n.with_prefix("xref", p)
    t = t.where(in_scope(F.col("id"), F.coalesce("name", F.lit("")), scope or {}, {"omim": of("OMIM:"), "umls": of("UMLS:")}))
    first = lambda p: n.first_or_empty(of(p))
    out = t.select(
        F.col("id").alias("mondo_id"), F.coalesce("name", F.lit("")).alias("disease_name"), x.definition_before_last_bracket(F.coalesce("def", F.lit(""))).alias("definition"), n.synonym_texts("synonym").alias("synonyms"), n.parents("is_a", "MONDO:").alias("is_a"),
        first("UMLS:").alias("umls_cui"), first("OMIM:").alias("omim_id"), first("Orphanet:").alias("orpha_id"), first("DOID:").alias("doid"), n.first_or_empty(n.either(of("ICD10CM:"), of("ICD10:"))).alias("icd10cm"), first("MESH:").alias("mesh_id"), first("SNOMEDCT:").alias("snomed_id"))
    return {"disease_nodes": _from(out, "MONDO")}


def depth_below(obo: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """(id, depth): fewest is_a steps down from the root, level by level."""
    from weftline.graph.algo import bfs_depth

    e = obo.select(F.col("id").alias("child"), F.explode("is_a").alias("p")).select("child", x.before("p", " !").alias("parent"))
    return bfs_depth(e.select(F.col("parent").alias("src"), F.col("child").alias("dst")), root, max_depth).withColumnRenamed("node", "id")


def disease_ontology(obo: DataFrame, slim: DataFrame | None = None, scope: dict[str, list[str]] | None = None, root: str = "DOID:4") -> dict[str, DataFrame]:
    """slim(doid): ids that are in whatever their scope. Terms all of whose parents lie
    at most one step below the root are too broad; without parents a term stays."""
    depth = depth_below(obo, root)
    t = obo.where(F.startswith("id", F.lit("DOID:")) & ~F.col("is_obsolete"))
    of = lambda p: n.with_prefix("xref", p)
    mesh = F.concat(of("MESH:"), of("MSH:"))
    matches = in_scope(F.col("id"), F.coalesce("name", F.lit("")), scope or {}, {"umls": of("UMLS_CUI:"), "mesh": mesh})
    if slim is not None:
        t = t.join(slim.select(F.col("doid").alias("id")).distinct().withColumn("_slim", F.lit(True)), "id", "left").where(F.coalesce("_slim", F.lit(False)) | matches)
    else:
        t = t.where(matches)
    up = t.select("id", F.explode("is_a").alias("p")).select("id", x.before("p", " !").alias("parent")).join(depth.select(F.col("id").alias("parent"), "depth"), "parent", "left")
    broad = up.groupBy("id").agg(F.max(F.coalesce("depth", F.lit(999))).alias("m")).where("m <= 1").select("id")
    t = t.join(broad, "id", "left_anti")
    d = F.coalesce("def", F.lit(""))
    symptoms = F.array_join(F.filter(F.transform(F.regexp_extract_all(d, F.lit(r"(?i)has[_ ]symptom\s+([^,.\[]+)"), F.lit(1)), lambda s: x.rstrip_chars(x.strip(s), '"')), lambda s: s != ""), "|")
    first = lambda p: n.first_or_empty(of(p))
    snomed = n.first_or_empty(F.transform(n.with_prefix("xref", "SNOMEDCT_US", keep_prefix=True), lambda s: F.regexp_replace(s, "^[^:]*:", "")))
    out = t.select(
        F.col("id").alias("doid"), F.coalesce("name", F.lit("")).alias("disease_name"), x.rstrip_chars(x.definition_before_last_bracket(d), ",;.").alias("definition"), first("UMLS_CUI:").alias("umls_cui"), n.first_or_empty(mesh).alias("mesh_id"), first("MIM:").alias("omim_id"), first("NCI:").alias("ncit_id"),
        first("ICD10CM:").alias("icd10cm"), first("ICD9CM:").alias("icd9cm"), first("ORDO:").alias("ordo_id"), first("GARD:").alias("gard_id"), snomed.alias("snomed_id"), symptoms.alias("symptoms"))
    return {"slim_terms": _from(out, "Disease Ontology")}


def uberon(basic: DataFrame, human: DataFrame, include: str = "uberon_slim", exclude: Sequence[str] = ("non_informative", "upper_level", "grouping_class")) -> dict[str, DataFrame]:
    """Both as from obo.terms; only human anatomy of the slim comes out."""
    h = human.where(F.startswith("id", F.lit("UBERON:"))).select("id").distinct().withColumn("_human", F.lit(1))
    t = basic.where(F.startswith("id", F.lit("UBERON:")) & ~F.col("is_obsolete")).join(h, "id", "left")
    t = t.where((F.col("_human") == 1) & n.tagged("subset", include, list(exclude)))
    of = lambda *ps: F.array_join(F.filter("xref", lambda v: x.starts_with_any(F.upper(v), list(ps))), "|")
    out = t.select(
        F.col("id").alias("uberon_id"), F.coalesce("name", F.lit("")).alias("uberon_name"), n.synonym_texts("synonym").alias("synonyms"), x.first_quoted("def").alias("definition"), of("MESH:", "MSH:").alias("mesh_id"), of("FMA:").alias("fma_id"), of("BTO:").alias("bto_id"),
        F.array_join("subset", "|").alias("subsets"), F.coalesce("_human", F.lit(0)).alias("is_human"), n.parents("is_a", "UBERON:").alias("is_a"), n.parents("relationship", "UBERON:", "part_of").alias("part_of"))
    return {"uberon_nodes": _from(out, "Uberon")}


def hpo(obo: DataFrame | None, annotations: DataFrame | None = None, medgen: DataFrame | None = None) -> dict[str, DataFrame]:
    """annotations: database_id, qualifier, hpo_id, evidence, onset, frequency, sex, ...;
    medgen(cui, pref_name, source_id, source[, _ord]), of which the last row of an id wins."""
    out: dict[str, DataFrame] = {}
    if obo is not None:
        t = obo.where(F.startswith("id", F.lit("HP:")) & ~F.col("is_obsolete"))
        out["phenotype_nodes"] = _from(t.select(F.col("id").alias("hp_id"), F.coalesce("name", F.lit("")).alias("name"), x.definition_before_first_bracket(F.coalesce("def", F.lit(""))).alias("definition"), n.synonym_texts("synonym").alias("synonyms"), n.parents("is_a", "HP:").alias("is_a")), "HPO")
    if annotations is not None:
        cols = ["qualifier", "evidence", "onset", "frequency", "sex"]
        a = annotations.select(x.strip("database_id").alias("database_id"), x.strip("hpo_id").alias("hp_id"), *[F.coalesce(x.strip(c), F.lit("")).alias(c) for c in cols]).where((F.col("database_id") != "") & F.startswith("hp_id", F.lit("HP:")))
        if medgen is not None:
            key = F.when(F.col("source") == "OMIM", F.concat(F.lit("OMIM:"), "source_id")).when(F.col("source") == "Orphanet", F.concat(F.lit("ORPHA:"), F.replace("source_id", F.lit("Orphanet_"), F.lit(""))))
            order = F.col("_ord") if "_ord" in medgen.columns else F.col("cui")
            m = medgen.select(key.alias("key"), "cui", order.alias("o")).where("key is not null").groupBy("key").agg(F.max_by("cui", "o").alias("cui"))
            a = lookup(a, m, "database_id", "key", "cui", "cui", "")
        else:
            a = a.withColumn("cui", F.lit(""))
        edges = ["hp_id", "cui", "evidence", "onset", "frequency", "sex"]
        out["disease_phenotype_positive"] = _from(a.where("qualifier <> 'NOT'").select(*edges).distinct(), "HPO")
        out["disease_phenotype_negative"] = _from(a.where("qualifier = 'NOT'").select(*edges).distinct(), "HPO")
    return out


def mesh(descriptors: DataFrame, root: str = "C23.888") -> dict[str, DataFrame]:
    """descriptors(mesh_id, mesh_name, tree_numbers array): those strictly below the root."""
    d = descriptors.where(F.exists("tree_numbers", lambda t: F.startswith(t, F.lit(root + "."))))
    return {"symptom_nodes": _from(d.select("mesh_id", "mesh_name"), "MeSH", "sourceDatabase")}


def disgenet(items: DataFrame) -> dict[str, DataFrame]:
    """items: saved result pages (readers.json_pages with the fields below)."""
    # The vocabularies that get a column.
    vocab = ["MSH", "ICD10", "NCI", "OMIM", "ICD9CM", "HPO", "DO", "MONDO", "UMLS", "EFO", "ORDO"]
    # Entries are PREFIX_code, in any letter case; the first code of a vocabulary counts.
    prefix = lambda v: F.upper(F.substring_index(v, "_", 1))
    key = lambda v: F.when(prefix(v) == "MESH", "MSH").when(prefix(v).isin(vocab[1:]), prefix(v))
    entries = F.filter(F.coalesce("diseaseVocabularies", F.array().cast("array<string>")), lambda v: v.contains("_") & key(v).isNotNull())
    codes = n.first_wins(F.transform(entries, lambda v: F.struct(key(v).alias("key"), F.substring(v, F.instr(v, "_") + 1, F.length(v)).alias("value"))))
    first = lambda c: F.try_element_at(c, F.lit(1))
    g = items.withColumn("_v", codes).select(
        F.col("geneNcbiID").cast("string").alias("geneId"), F.col("symbolOfGene").alias("geneSymbol"), first(F.col("geneEnsemblIDs")).alias("ensemblId"), first(F.col("geneProteinStrIDs")).alias("proteinId"), F.col("genepLI").alias("pLI"), F.col("geneDSI").alias("DSI"), F.col("geneDPI").alias("DPI"),
        F.col("diseaseUMLSCUI").alias("diseaseId"), "diseaseName", "diseaseType", n.joined_or_null("diseaseClasses_MSH").alias("diseaseClass"), n.joined_or_null("diseaseClasses_UMLS_ST").alias("diseaseSemanticType"),
        F.col("score").alias("gdaScore"), F.col("ei").alias("evidenceIndex"), F.col("numPMIDs").alias("numberOfPublications"), *[F.col("_v")[v].alias(v) for v in vocab]).distinct()
    g = g.withColumn("DO", F.when(F.startswith("DO", F.lit("DOID:")), F.col("DO")).otherwise(F.concat(F.lit("DOID:"), "DO")))
    gene_cols, dis_cols = ["geneId", "geneSymbol", "ensemblId", "proteinId", "pLI", "DSI", "DPI"], ["diseaseId", "diseaseName", "diseaseType", "diseaseClass", "diseaseSemanticType", *vocab]
    genes, diseases = g.select(*gene_cols), g.select(*dis_cols)
    edges = g.select("geneId", "diseaseId", "gdaScore", "evidenceIndex", "numberOfPublications", F.lit(None).cast("long").alias("numberOfSnps"))
    return {"genes": _from(keep_first(genes, ["geneId"], _order(genes)), "DisGeNET"), "diseases": _from(keep_first(diseases, ["diseaseId"], _order(diseases)), "DisGeNET"), "gene_disease_associations": _from(edges, "DisGeNET")}


# chemicals and drugs

def ctd_chemical(interactions: DataFrame, vocabulary: DataFrame | None = None) -> dict[str, DataFrame]:
    """interactions: ChemicalName, ChemicalID, GeneID, Interaction, OrganismID,
    InteractionActions, PubMedIDs; vocabulary: ChemicalID, CasRN, PubChemCID, DTXSID, InChIKey, ParentIDs."""
    i = interactions.withColumn("ChemicalID", x.ensure_prefix("ChemicalID", "MESH:", empty_for_null=True)).where((F.col("ChemicalID") != "") & ~x.is_blank("GeneID") & F.col("InteractionActions").isNotNull())
    e = i.withColumn("action", F.explode(n.split_list("InteractionActions"))).where(F.lower("action").contains("^expression"))
    blank = lambda c: F.coalesce(x.strip(c), F.lit(""))

    def edges(start: str) -> DataFrame:
        return _from(e.where(F.startswith(F.lower("action"), F.lit(start))).select(F.col("ChemicalID").alias("chemical_id"), x.strip("GeneID").alias("gene_id"), blank("Interaction").alias("interaction_text"), blank("OrganismID").alias("organism"), F.coalesce("PubMedIDs", F.lit("")).alias("pubmed_id")).distinct(), "CTD")

    chem = e.select(F.col("ChemicalID").alias("chemical_id"), F.col("ChemicalName").alias("chemical_name"), *(["_ord"] if "_ord" in e.columns else []))
    nodes = keep_first(chem, ["chemical_id"], _order(chem)).select("chemical_id", "chemical_name").withColumn("mesh_id", F.col("chemical_id"))
    extra = ["cas_number", "pubchem_cid", "inchikey", "dtxsid", "mesh_parent_ids"]
    if vocabulary is not None:
        v = vocabulary.select(x.ensure_prefix("ChemicalID", "MESH:", empty_for_null=True).alias("chemical_id"), blank("CasRN").alias("cas_number"), x.lstrip_chars(blank("PubChemCID"), "CID:").alias("pubchem_cid"), blank("InChIKey").alias("inchikey"), blank("DTXSID").alias("dtxsid"), blank("ParentIDs").alias("mesh_parent_ids"), *(["_ord"] if "_ord" in vocabulary.columns else [])).where("chemical_id <> ''")
        nodes = nodes.join(keep_first(v, ["chemical_id"], _order(v)).select("chemical_id", *extra), "chemical_id", "left")
    else:
        nodes = nodes.select("*", *[F.lit("").alias(c) for c in extra])
    return {"chemical_nodes": _from(nodes, "CTD"), "chemical_increases_expression": edges("increases^"), "chemical_decreases_expression": edges("decreases^")}


def ctd_exposure(events: DataFrame, go_terms: DataFrame | None = None) -> dict[str, DataFrame]:
    """events: Stressors, Receptors, Diseases, GOTerms (entries by |, parts by ^) and
    PubmedID; go_terms(go_id, namespace). Pairs within an event are two explodes
    of one row: no join, no shuffle before the distinct."""
    s = events.withColumn("s", F.explode(F.filter(n.split_entries("Stressors", least=2), lambda p: p[1] != ""))).withColumn("pubmedId", F.coalesce(x.strip("PubmedID"), F.lit("")))
    s = s.withColumn("xrefMeSH", F.col("s")[1])
    nodes = s.select("xrefMeSH", F.col("s")[0].alias("commonName"), *(["_ord"] if "_ord" in s.columns else []))
    out = {"exposure_nodes": _from(keep_first(nodes, ["xrefMeSH"], _order(nodes)).select("xrefMeSH", "commonName"), "CTD")}
    dis = s.withColumn("d", F.explode(F.filter(n.split_entries("Diseases", least=2), lambda p: p[1] != "")))
    out["exposure_linked_to_disease"] = _from(dis.select("xrefMeSH", F.col("d")[1].alias("disease_id"), "pubmedId").distinct(), "CTD")
    gene = s.withColumn("r", F.explode(F.filter(n.split_entries("Receptors", least=3), lambda p: (F.lower(p[1]) == "gene") & (p[2] != ""))))
    out["exposure_interacts_with_gene"] = _from(gene.select("xrefMeSH", F.col("r")[2].alias("xrefNcbiGene"), F.col("r")[0].alias("geneSymbol"), "pubmedId").distinct(), "CTD")
    if go_terms is not None:
        go = s.withColumn("g", F.explode(F.filter(n.split_entries("GOTerms", least=2), lambda p: F.startswith(p[1], F.lit("GO:"))))).select("xrefMeSH", F.col("g")[1].alias("xrefGeneOntology"), "pubmedId")
        go = go.join(go_terms.select(F.col("go_id").alias("xrefGeneOntology"), "namespace").distinct(), "xrefGeneOntology")
        for ns in NAMESPACES:
            out[f"exposure_interacts_with_{ns}"] = _from(go.where(F.col("namespace") == ns).select("xrefMeSH", "xrefGeneOntology", "pubmedId").distinct(), "CTD")
    return out


def go_namespaces(enriched: DataFrame) -> DataFrame:
    """(go_id, namespace) of the enrichment table: GOTermID, Ontology (spelled out)."""
    return enriched.select(x.strip("GOTermID").alias("go_id"), F.replace(F.lower(x.strip("Ontology")), F.lit(" "), F.lit("_")).alias("namespace")).where("go_id <> ''").distinct()


def sider(effects: DataFrame, terms: DataFrame) -> dict[str, DataFrame]:
    """effects(stitch_flat, stitch_stereo, umls_label, concept_type, umls_meddra, name),
    terms(umls_cui, concept_type, meddra_id, name); preferred terms only."""
    t = terms.where((F.col("concept_type") == "PT") & ~x.is_blank("umls_cui") & ~x.is_blank("meddra_id"))
    t = keep_first(t.select(x.strip("umls_cui").alias("umls_cui"), x.strip("meddra_id").alias("meddra_id"), *(["_ord"] if "_ord" in t.columns else [])), ["umls_cui"], ["_ord"] if "_ord" in t.columns else ["meddra_id"]).select("umls_cui", "meddra_id")
    e = effects.where((F.col("concept_type") == "PT") & ~x.is_blank("stitch_flat") & ~x.is_blank("umls_meddra")).select(x.stitch_to_compound("stitch_flat").alias("pubchem_cid"), x.strip("umls_meddra").alias("umls_cui")).distinct().where("pubchem_cid <> ''")
    return {"chemical_causes_effect": _from(e.join(t, "umls_cui").select("pubchem_cid", "meddra_id").distinct(), "SIDER")}


def bindingdb(measurements: DataFrame, id_map: DataFrame, organism: str = "Homo sapiens") -> dict[str, DataFrame]:
    """measurements(drugbank_id, uniprot_id, organism), id_map(uniprot_id, ncbi_gene_id).
    Measurements are made distinct per drug and protein before the organism is
    looked at, so that the first row decides (by _ord, else by organism)."""
    m = measurements.select("drugbank_id", "uniprot_id", "organism", *(["_ord"] if "_ord" in measurements.columns else []))
    m = keep_first(m, ["drugbank_id", "uniprot_id"], ["_ord"] if "_ord" in m.columns else ["organism"]).where(x.contains_ci("organism", organism))
    real = lambda c: ~x.is_blank(c) & (F.upper(x.strip(c)) != "NULL")
    m = m.where(real("drugbank_id") & real("uniprot_id")).select(x.strip("drugbank_id").alias("drugbank_id"), x.strip("uniprot_id").alias("uniprot_id"))
    ids = id_map.where(F.col("ncbi_gene_id").isNotNull() & ~F.col("ncbi_gene_id").isin("", "-")).groupBy("uniprot_id").agg(F.min("ncbi_gene_id").alias("ncbi_gene_id"))
    return {"drug_binds_gene": _from(m.join(ids, "uniprot_id").select("drugbank_id", "ncbi_gene_id").distinct(), "BindingDB")}


def drugbank(drugs: DataFrame) -> dict[str, DataFrame]:
    """drugs: rows of the XML source with rowTag drug (DRUG_XML); nested drugs have no type
    attribute and are not rows of their own. Kept with any cross reference."""
    txt = lambda c: F.coalesce(x.one_line(c), F.lit(""))
    arr = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    d = drugs.where("_type is not null")
    ids = F.filter(F.col("drugbank-id"), lambda i: i["_primary"] == "true")
    prop = n.last_wins(F.transform(arr("`calculated-properties`.property", "array<struct<kind:string,value:string>>"), lambda p: F.struct(x.strip(p["kind"]).alias("key"), F.coalesce(x.strip(p["value"]), F.lit("")).alias("value"))))
    ext = n.last_wins(F.filter(F.transform(arr("`external-identifiers`.`external-identifier`", "array<struct<resource:string,identifier:string>>"), lambda p: F.struct(x.strip(p["resource"]).alias("key"), x.strip(p["identifier"]).alias("value"))), lambda p: (p["key"] != "") & (p["value"] != "")))
    d = d.withColumn("drugbank_id", x.strip(F.try_element_at(ids, F.lit(1))["_VALUE"])).where("drugbank_id <> ''").withColumn("_p", prop).withColumn("_e", ext)
    of = lambda m, k: F.coalesce(x.one_line(F.col(m)[k]), F.lit(""))
    joined = lambda c: F.coalesce(F.array_join(F.transform(F.col(c), lambda s: x.one_line(s)), "; "), F.lit(""))
    rows = d.select(
        "drugbank_id", txt("name").alias("drug_name"), txt("description").alias("drugDescription"), F.col("_type").alias("drugType"), joined("groups.group").alias("drugGroups"), joined("categories.category.category").alias("drugCategories"), txt("indication").alias("drugIndication"), txt("pharmacodynamics").alias("drugPharmacology"),
        txt("`mechanism-of-action`").alias("drugMechanism"), txt("toxicity").alias("drugToxicity"), txt("`half-life`").alias("drugHalfLife"), txt("state").alias("drugState"), of("_p", "Molecular Formula").alias("molecularFormula"), of("_p", "Molecular Weight").alias("molecularWeight"), of("_p", "SMILES").alias("smiles"), of("_p", "InChI").alias("inchi"), of("_p", "InChIKey").alias("inchikey"),
        txt("`cas-number`").alias("cas_number"), of("_e", "KEGG Drug").alias("kegg_drug_id"), of("_e", "PubChem Compound").alias("pubchem_cid"), of("_e", "ChEMBL").alias("chembl_id"), of("_e", "ChEBI").alias("chebi_id"))
    part = lambda sec, tag: F.transform(F.coalesce(F.col(f"{sec}.{tag}"), F.array().cast(ACTORS)), lambda a: F.struct(F.coalesce(x.strip(a["polypeptide"]["gene-name"]), F.lit("")).alias("gene_symbol"), F.coalesce(a["polypeptide"]["_id"], F.lit("")).alias("uniprot_id"), F.lit(tag).alias("interaction_type")))
    edges = d.select("drugbank_id", F.explode(F.concat(*[part(s, t) for s, t in (("targets", "target"), ("enzymes", "enzyme"), ("carriers", "carrier"), ("transporters", "transporter"))])).alias("e")).select("drugbank_id", "e.*").where("gene_symbol <> '' or uniprot_id <> ''").distinct()
    return {"drugs": _from(_cross_referenced(keep_first(rows, ["drugbank_id"], _order(rows))), "DrugBank"), "drug_gene_edges": _from(edges, "DrugBank")}


ACTORS = "array<struct<polypeptide:struct<_id:string,`gene-name`:string>>>"
_SECTION = ", ".join(f"{s} struct<{t}:{ACTORS}>" for s, t in (("targets", "target"), ("enzymes", "enzyme"), ("carriers", "carrier"), ("transporters", "transporter")))
DRUG_XML = (
    "_type string, `drugbank-id` array<struct<_VALUE:string,_primary:string>>, name string, description string, `cas-number` string, groups struct<group:array<string>>, indication string, pharmacodynamics string, `mechanism-of-action` string, toxicity string, `half-life` string, state string, "
    "categories struct<category:array<struct<category:string>>>, `calculated-properties` struct<property:array<struct<kind:string,value:string>>>, `external-identifiers` struct<`external-identifier`:array<struct<resource:string,identifier:string>>>, " + _SECTION
)
CROSS_REFERENCES = ("cas_number", "chembl_id", "pubchem_cid", "chebi_id", "kegg_drug_id")


def _cross_referenced(d: DataFrame) -> DataFrame:
    return d.where(F.exists(F.array(*CROSS_REFERENCES), lambda c: ~x.is_blank(c)))


#: Headings of the links file and the columns they become.
DRUG_LINKS = {
    "DrugBank ID": "drugbank_id", "Name": "drug_name", "CAS Number": "cas_number", "Drug Type": "drugType", "KEGG Compound ID": "kegg_compound_id", "KEGG Drug ID": "kegg_drug_id", "PubChem Compound ID": "pubchem_cid", "PubChem Substance ID": "pubchem_sid", "ChEBI ID": "chebi_id",
    "PharmGKB ID": "pharmgkb_id", "UniProt ID": "uniprot_id", "UniProt Title": "uniprot_title", "GenBank ID": "genbank_id", "ChEMBL ID": "chembl_id",
}


def drugbank_links(links: DataFrame) -> dict[str, DataFrame]:
    """The fallback without the full file: identifiers only, other properties empty."""
    d = links.withColumnsRenamed(DRUG_LINKS)
    # What only the full file has.
    only_full = ["drugDescription", "drugGroups", "drugCategories", "drugIndication", "drugPharmacology", "drugMechanism", "drugToxicity", "drugHalfLife", "drugState", "molecularFormula", "molecularWeight", "smiles", "inchi", "inchikey", *CROSS_REFERENCES]
    for c in only_full:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(""))
    d = keep_first(d, ["drugbank_id"], _order(d))
    return {"drugs": _from(_cross_referenced(d.drop("_ord") if "_ord" in d.columns else d), "DrugBank")}


def drugcentral(structures: DataFrame, identifier: DataFrame, pharma_class: DataFrame, omop: DataFrame, faers: DataFrame, umls_cuis: Sequence[str] = (), min_llr: float = 0.0) -> dict[str, DataFrame]:
    """Tables of the SQL dump, as DataFrames or JDBC scans. Without ``umls_cuis`` there are no indications."""
    kinds = {"DRUGBANK_ID": "drugbank_id", "CHEBI": "chebi_id", "PUBCHEM_CID": "pubchem_cid", "MESH_DESCRIPTOR_UI": "mesh_id", "UMLSCUI": "umls_cui"}
    ids = identifier.groupBy("struct_id").agg(*[F.max(F.when(F.col("id_type") == k, F.col("identifier"))).alias(v) for k, v in kinds.items()])
    s = structures.select(F.col("id").alias("struct_id"), F.col("cas_reg_no").alias("cas_number"), F.col("name").alias("drug_name"), "inchikey", "inchi", "smiles", F.col("cd_molweight").alias("molecular_weight"), F.col("cd_formula").alias("molecular_formula"), F.col("clogp").alias("logp"), "tpsa", F.col("lipinski").alias("lipinski_compliance")).distinct()
    drugs = s.join(ids, "struct_id", "left")
    pc = pharma_class.withColumn("pharma_class_id", F.concat(F.coalesce("source", F.lit("DC")), F.lit(":"), "class_code"))
    classes = pc.where("class_code is not null and name is not null").groupBy("pharma_class_id").agg(F.min(F.struct("name", "class_code")).alias("m")).select("pharma_class_id", F.col("m.name").alias("pharma_class_name"), F.col("m.class_code").alias("pharma_class_code"))
    out = {"drugs": _from(drugs, "drugcentral"), "pharmacologic_classes": _from(classes, "drugcentral"), "drug_in_class": _from(pc.where("class_code is not null and struct_id is not null").select("struct_id", "pharma_class_id").distinct(), "drugcentral")}
    if umls_cuis:
        t = omop.where((F.col("relationship_name") == "indication") & F.col("umls_cui").isin(list(umls_cuis)))
        out["drug_treats_disease"] = _from(t.select("struct_id", F.col("umls_cui").alias("disease_id"), F.col("relationship_name").alias("indication")).distinct(), "drugcentral")
    f = faers.where((F.col("llr") > F.col("llr_threshold")) & (F.col("drug_ae") >= 3) & gt("llr", min_llr))
    out["chemical_causes_effect"] = _from(f.select("struct_id", F.col("meddra_code").alias("adverse_effect_id"), F.col("meddra_name").alias("adverse_effect_name"), "llr", "drug_ae"), "drugcentral")
    return out


def aopdb(pathway_gene: DataFrame, chemical_info: DataFrame, taxon: int = 9606) -> dict[str, DataFrame]:
    name = x.drop_literals("path_name", "<sub>", "</sub>", "<i>", "</i>", " - Homo sapiens (human)")
    p = pathway_gene.where(F.col("tax_id") == taxon).select(F.col("entrez"), "path_id", name.alias("path_name"), "ext_source")
    ordered = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    paths = p.groupBy("path_name").agg(ordered("path_id").alias("path_id"), F.concat(F.lit("AOPDB - "), ordered("ext_source")).alias("ext_source")).withColumn("path_iri", x.slug("path_name"))
    return {"pathways": _from(paths, "AOPDB"), "gene_pathway_relationships": _from(p.select("entrez", "path_id", "path_name").distinct(), "AOPDB"), "drugs": _from(chemical_info, "AOPDB")}


def medline(entity_docs: DataFrame, diseases: DataFrame, symptoms: DataFrame, anatomy: DataFrame) -> dict[str, DataFrame]:
    """entity_docs(mesh_id, doc); diseases(doid_code, mesh_id), symptoms(mesh_id),
    anatomy(uberon_id, mesh_id). Statistics per pair of entities; entities that
    share a MeSH id each pair for themselves."""
    from weftline.operators.enrichment import corpus_size, pair_statistics

    docs = entity_docs.where("mesh_id is not null and doc is not null").distinct()
    def of(e: DataFrame, id_: str, name: str) -> DataFrame:
        return e.select(F.col(id_).alias(name), F.regexp_replace("mesh_id", "^MESH:", "").alias("mesh_id")).distinct().join(docs, "mesh_id").select(name, "doc", "mesh_id")

    d, dt = of(diseases, "doid_code", "source_id"), of(diseases, "doid_code", "target_id")
    s, a = of(symptoms, "mesh_id", "target_id"), of(anatomy, "uberon_id", "target_id")
    src = lambda t, k, m: t.join(d.select(F.col("source_id").alias(k), F.col("mesh_id").alias(m)).distinct(), k)
    out = {}
    ds = pair_statistics(d, s, corpus_size(d, s)).withColumnRenamed("source_id", "doid_code").withColumnRenamed("target_id", "mesh_id")
    out["disease_symptom_cooccurrence"] = _from(src(ds, "doid_code", "source_mesh"), "MEDLINE")
    da = pair_statistics(d, a, corpus_size(d, a)).withColumnRenamed("source_id", "doid_code").withColumnRenamed("target_id", "uberon_id")
    da = src(da, "doid_code", "source_mesh").join(a.select(F.col("target_id").alias("uberon_id"), F.col("mesh_id").alias("target_mesh")).distinct(), "uberon_id")
    out["disease_anatomy_cooccurrence"] = _from(da, "MEDLINE")
    dd = pair_statistics(d, dt, d.select("doc").distinct().count(), upper_triangle=True).withColumnRenamed("source_id", "doid_code_0").withColumnRenamed("target_id", "doid_code_1")
    out["disease_disease_cooccurrence"] = _from(src(src(dd, "doid_code_0", "mesh_id_0"), "doid_code_1", "mesh_id_1"), "MEDLINE")
    return out


def slim_terms(topnodes: DataFrame, cancer: DataFrame, studies: DataFrame, mondo_obo: DataFrame, doid_obo: DataFrame, min_studies: int = 20) -> DataFrame:
    """Well-studied diseases: topnodes(doid, name) that exist, terms with more than
    ``min_studies`` distinct studies(trait_uris, study) by way of their MONDO cross
    references, and cancer(doid, name), which override both; sorted by id."""
    live = doid_obo.where("not is_obsolete").select(F.col("id").alias("doid"), F.coalesce("name", F.lit("")).alias("name"))
    uris = studies.select("study", F.explode(n.split_list("trait_uris", ",")).alias("uri")).select("study", F.regexp_extract("uri", r"MONDO_(\d+)", 1).alias("m")).where("m <> ''")
    often = uris.groupBy(F.concat(F.lit("MONDO:"), "m").alias("mondo")).agg(F.countDistinct("study").alias("n")).where(F.col("n") > min_studies)
    to_doid = mondo_obo.where("not is_obsolete").select(F.col("id").alias("mondo"), F.explode(F.filter("xref", lambda v: F.startswith(v, F.lit("DOID:")))).alias("doid"))
    base = topnodes.select("doid").unionByName(often.join(to_doid, "mondo").select("doid")).distinct().join(live, "doid")
    from weftline.operators.rows import override_union

    return override_union(base.select("doid", "name"), cancer.select("doid", "name"), "doid", ["name"]).orderBy("doid")
