"""Sources by name: how each is read from its landing folder, its plan, and its outputs.

A run goes through the sources that are enabled, hands each plan what it asks for
by name (arguments of the configuration, the scope of diseases where a plan
declares it), and completes the outputs: every declared table is there, an empty
typed one where an input is missing. A source that fails is reported and left
out; the others go on. New sources are added with ``register``.
"""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.graph.export import write_tsv
from weftline.sources import obo, readers, tables
from weftline.sources.readers import delimited, first_existing, ragged

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Input:
    """One input of a plan: file names (the first that exists counts) and how to read it.
    Without any of the files the input is None."""

    names: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame]
    required: bool = True


@dataclass(frozen=True)
class Source:
    """inputs: by the plan's parameter names; outputs: table name -> schema (DDL)."""

    name: str
    plan: Callable[..., dict[str, DataFrame]]
    inputs: dict[str, Input] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
        out: dict[str, DataFrame | None] = {}
        for k, i in self.inputs.items():
            path = first_existing(spark, folder, i.names)
            out[k] = i.read(spark, path) if path else None
        return out

    def tables(self, spark: SparkSession, given: dict[str, object]) -> dict[str, DataFrame]:
        """The plan's tables from inputs and arguments, of which it gets those it declares."""
        wanted = inspect.signature(self.plan).parameters
        missing = [k for k, i in self.inputs.items() if i.required and given.get(k) is None]
        made = {} if missing else self.plan(**{k: v for k, v in given.items() if k in wanted})
        return complete(spark, made, self.outputs)


def complete(spark: SparkSession, made: dict[str, DataFrame], outputs: dict[str, str]) -> dict[str, DataFrame]:
    """All declared tables: an empty one with the declared columns for each that was not made."""
    return {**made, **{k: spark.createDataFrame([], ddl) for k, ddl in outputs.items() if k not in made}}


REGISTRY: dict[str, Source] = {}


def register(source: Source) -> Source:
    if source.name in REGISTRY:
        raise ValueError(f"there is a source {source.name} already")
    REGISTRY[source.name] = source
    return source


def run(spark: SparkSession, landing: str, config: dict[str, dict], shared: dict[str, object] | None = None) -> tuple[dict[str, dict[str, DataFrame]], dict[str, str]]:
    """(tables by source, what went wrong by source). ``config``: per source ``enabled``,
    ``args`` and ``folder`` (its landing folder's name, by default the source's);
    ``shared``: values that go to every plan that declares them, such as scope."""
    done: dict[str, dict[str, DataFrame]] = {}
    failed: dict[str, str] = {}
    for name, c in config.items():
        if not isinstance(c, dict) or not c.get("enabled", False):
            continue
        if name not in REGISTRY:
            failed[name] = "no such source"
            continue
        s = REGISTRY[name]
        try:
            given = {**(shared or {}), **c.get("args", {}), **s.read(spark, f"{landing}/{c.get('folder', name)}")}
            done[name] = s.tables(spark, given)
        except Exception as e:  # noqa: BLE001
            log.exception("source %s", name)
            failed[name] = str(e)
    return done, failed


def write_tables(done: dict[str, dict[str, DataFrame]], folder: str) -> None:
    """<folder>/<source>/<table>.tsv for every table."""
    for source, made in done.items():
        for name, df in made.items():
            write_tsv(df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("map", "struct")) else F.col(c) for c, t in df.dtypes]), f"{folder}/{source}/{name}.tsv")


def _tsv(*columns: str, header: bool = False, quote: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: delimited(spark, path, columns, header=header, quote=quote)


def _commented(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: ragged(spark, path, columns, skip="#", with_ordinal=True)


def _named(sep: str = "\t", quote: str = '"', renamed: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A file with a header, its columns by name and renamed."""
    def read(spark: SparkSession, path: str) -> DataFrame:
        t = spark.read.option("sep", sep).option("header", "true").option("quote", quote).csv(path)
        return t.withColumnsRenamed(renamed or {})

    return read


_obo = obo.terms


def _descriptors(spark: SparkSession, path: str) -> DataFrame:
    x = readers.xml_rows(spark, path, "DescriptorRecord", "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>")
    return x.select(F.col("DescriptorUI").alias("mesh_id"), F.col("DescriptorName.String").alias("mesh_name"), F.coalesce("TreeNumberList.TreeNumber", F.array().cast("array<string>")).alias("tree_numbers"))


#: Items of saved result pages.
GDA_ITEM = "geneNcbiID long, symbolOfGene string, geneEnsemblIDs array<string>, geneProteinStrIDs array<string>, genepLI double, geneDSI double, geneDPI double, diseaseUMLSCUI string, diseaseName string, diseaseType string, diseaseClasses_MSH array<string>, diseaseClasses_UMLS_ST array<string>, score double, ei double, numPMIDs long, diseaseVocabularies array<string>"


def _pages(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return readers.json_pages(spark, path, StructType.fromDDL(GDA_ITEM))


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _pmids(spark: SparkSession, path: str) -> DataFrame:
    return readers.id_per_file(spark, path, "mesh_id")


def _matrix_plan(matrix: DataFrame, threshold: float = 117**0.5) -> dict[str, DataFrame]:
    labels = [c for c in matrix.columns if c != "_label"]
    at = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, i)])
    rows = matrix.select(at[F.col("_label")].alias("i"), F.array(*[F.col(f"`{c}`").try_cast("double") for c in labels]).alias("scores")).where("i is not null")
    return tables.rate_covariation(rows, labels, threshold)


def _matrix(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("header", "true").csv(path)
    return t.withColumnRenamed(t.columns[0], "_label")


def _drugbank_plan(drugs: DataFrame | None = None, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """The full file if it is there, else the identifiers."""
    return tables.drugbank(drugs) if drugs is not None else tables.drugbank_links(links) if links is not None else {}


def _texts(columns: str, extra: str = "") -> str:
    return ", ".join([f"{c} string" for c in columns.split()] + ([extra] if extra else []))


def _all(*items: tuple[str, Callable, dict[str, Input], dict[str, str]]) -> None:
    for name, plan, inputs, outputs in items:
        register(Source(name, plan, inputs, outputs))


# Names of files, their columns, and the tables that come out.
_PAIR = "cooccurrence long, enrichment double, p_fisher double, odds_ratio double"

_all(
    ("ncbigene", tables.ncbigene, {"gene_info": Input(("Homo_sapiens.gene_info*",), _tsv("tax_id", "GeneID", "Symbol", "LocusTag", "Synonyms", "dbXrefs", "chromosome", "map_location", "description", "type_of_gene", "Symbol_from_nomenclature_authority", "Full_name_from_nomenclature_authority", "Nomenclature_status", "Other_designations", "Modification_date", "Feature_type", header=True))},
     {"genes": _texts("GeneID Symbol Synonyms dbXrefs chromosome description type_of_gene Full_name_from_nomenclature_authority", "xrefs map<string,string>, source_database string")}),
    ("string", tables.string_ppi, {"links": Input(("*.protein.links.*",), lambda s, p: delimited(s, p, ["protein1", "protein2", "combined_score"], sep=" ", header=True)), "aliases": Input(("*.protein.aliases.*",), _tsv("string_protein_id", "alias", "source", header=True))},
     {"gene_interactions": "gene_id_1 string, gene_id_2 string, combined_score long, source_database string"}),
    ("bgee", tables.bgee, {"calls": Input(("expr_calls.tsv*",), _named(renamed={"Gene ID": "gene_id", "Anatomical entity ID": "anatomical_entity_id", "Expression": "expression", "Call quality": "call_quality", "FDR": "fdr", "Expression score": "expression_score", "Expression rank": "expression_rank"}))},
     {"anatomy_expresses_gene": "uberon_id string, ensembl_gene_id string, expression_call string, call_quality string, fdr double, expression_score double, expression_rank double, unbiased boolean, sourceDatabase string"}),
    ("collectri", tables.collectri, {"interactions": Input(("tf_gene_interactions.tsv",), _named())},
     {"transcription_factors": _texts("tf_symbol source_database"), "tf_gene_interactions": "tf_symbol string, target_gene string, is_directed int, is_stimulation int, is_inhibition int, consensus_direction int, consensus_stimulation int, consensus_inhibition int, source_database string"}),
    ("dorothea", tables.dorothea, {"interactions": Input(("tf_gene_interactions.tsv",), _named())},
     {"transcription_factors": _texts("tf_symbol node_type source_database"), "tf_gene_interactions": "tf_symbol string, target_gene string, tf_uniprot string, target_uniprot string, confidence string, curation_effort string, mode_of_regulation string, mor_score int, is_directed string, relationship string, source_database string"}),
    ("gene_ontology", tables.gene_ontology, {"obo": Input(("go-basic.obo", "go.obo"), _obo), "gaf": Input(("goa_human.gaf*",), lambda s, p: ragged(s, p, ["DB", "DB_Object_ID", "DB_Object_Symbol", "Qualifier", "GO_ID", "DB_Reference", "Evidence_Code", "With_From", "Aspect", "DB_Object_Name", "DB_Object_Synonym", "DB_Object_Type", "Taxon", "Date", "Assigned_By", "Annotation_Extension", "Gene_Product_Form_ID"], least=15, skip="!", with_ordinal=True))},
     {**{f"{n}_nodes": _texts("go_id name definition source_database") for n in tables.NAMESPACES}, **{f"gene_{k}_associations": _texts("gene_symbol go_id evidence source_database") for k in ("bp", "mf", "cc")}}),
    ("reactome", tables.reactome, {"pathways": Input(("ReactomePathways.txt",), _tsv("reactome_id", "pathway_name", "species")), "genes": Input(("NCBI2Reactome_All_Levels.txt",), _tsv("ncbi_gene_id", "reactome_id", "url", "name", "evidence_code", "species"))},
     {"pathways": _texts("reactome_id pathway_name species source_database"), "ncbi_gene_pathway_relationships": _texts("ncbi_gene_id reactome_id evidence_code source_database")}),
    ("evolutionary_rate_covariation", _matrix_plan, {"matrix": Input(("*.csv", "*.csv.gz"), _matrix)}, {"gene_covariation": "source_hgnc string, target_hgnc string, erc_score double, source_database string"}),
    ("mondo", tables.mondo, {"obo": Input(("mondo.obo",), _obo)}, {"disease_nodes": _texts("mondo_id disease_name definition synonyms is_a umls_cui omim_id orpha_id doid icd10cm mesh_id snomed_id source_database")}),
    ("disease_ontology", tables.disease_ontology, {"obo": Input(("doid.obo",), _obo), "slim": Input(("slim_terms.tsv",), _named(), required=False)},
     {"slim_terms": _texts("doid disease_name definition umls_cui mesh_id omim_id ncit_id icd10cm icd9cm ordo_id gard_id snomed_id symptoms source_database")}),
    ("uberon", tables.uberon, {"basic": Input(("basic.obo",), _obo), "human": Input(("human-view.obo",), _obo)}, {"uberon_nodes": _texts("uberon_id uberon_name synonyms definition mesh_id fma_id bto_id subsets", "is_human int, is_a string, part_of string, source_database string")}),
    ("hpo", tables.hpo, {"obo": Input(("hp.obo",), _obo, required=False), "annotations": Input(("phenotype.hpoa",), lambda s, p: ragged(s, p, ["database_id", "disease_name", "qualifier", "hpo_id", "reference", "evidence", "onset", "frequency", "sex", "modifier", "aspect", "biocuration"], least=4, skip="#"), required=False), "medgen": Input(("MedGenIDMappings.txt*",), lambda s, p: ragged(s, p, ["cui", "pref_name", "source_id", "source"], sep="|", least=4, skip="#", with_ordinal=True), required=False)},
     {"phenotype_nodes": _texts("hp_id name definition synonyms is_a source_database"), **{f"disease_phenotype_{k}": _texts("hp_id cui evidence onset frequency sex source_database") for k in ("positive", "negative")}}),
    ("mesh", tables.mesh, {"descriptors": Input(("desc*.xml",), _descriptors)}, {"symptom_nodes": _texts("mesh_id mesh_name sourceDatabase")}),
    ("disgenet", tables.disgenet, {"items": Input(("pages", "*.json"), _pages)},
     {"genes": "geneId string, geneSymbol string, ensemblId string, proteinId string, pLI double, DSI double, DPI double, source_database string", "diseases": _texts("diseaseId diseaseName diseaseType diseaseClass diseaseSemanticType MSH ICD10 NCI OMIM ICD9CM HPO DO MONDO UMLS EFO ORDO source_database"), "gene_disease_associations": "geneId string, diseaseId string, gdaScore double, evidenceIndex double, numberOfPublications long, numberOfSnps long, source_database string"}),
    ("ctd_chemical", tables.ctd_chemical, {"interactions": Input(("CTD_chem_gene_ixns.tsv*",), _commented("ChemicalName", "ChemicalID", "CasRN", "GeneSymbol", "GeneID", "GeneForms", "Organism", "OrganismID", "Interaction", "InteractionActions", "PubMedIDs")), "vocabulary": Input(("CTD_chemicals.tsv*",), _commented("ChemicalName", "ChemicalID", "CasRN", "PubChemCID", "PubChemSID", "DTXSID", "InChIKey", "Definition", "ParentIDs", "TreeNumbers", "ParentTreeNumbers", "MESHSynonyms", "CTDCuratedSynonyms"), required=False)},
     {"chemical_nodes": _texts("chemical_id chemical_name mesh_id cas_number pubchem_cid inchikey dtxsid mesh_parent_ids source_database"), **{f"chemical_{k}_expression": _texts("chemical_id gene_id interaction_text organism pubmed_id source_database") for k in ("increases", "decreases")}}),
    ("ctd_exposure", tables.ctd_exposure, {"events": Input(("CTD_exposure_studies.tsv*",), _commented("PubmedID", "StudyFactors", "Stressors", "Receptors", "Countries", "ExposureMedium", "ExposureMarkers", "Diseases", "GOTerms", "StudyNotes")), "go_terms": Input(("CTD_chem_go_enriched.tsv*",), lambda s, p: tables.go_namespaces(_commented("ChemicalName", "ChemicalID", "CasRN", "Ontology", "GOTermName", "GOTermID", "HighestGOLevel", "PValue", "CorrectedPValue", "TargetMatchQty", "TargetTotalQty", "BackgroundMatchQty", "BackgroundTotalQty")(s, p)), required=False)},
     {"exposure_nodes": _texts("xrefMeSH commonName source_database"), "exposure_linked_to_disease": _texts("xrefMeSH disease_id pubmedId source_database"), "exposure_interacts_with_gene": _texts("xrefMeSH xrefNcbiGene geneSymbol pubmedId source_database"), **{f"exposure_interacts_with_{n}": _texts("xrefMeSH xrefGeneOntology pubmedId source_database") for n in tables.NAMESPACES}}),
    ("sider", tables.sider, {"effects": Input(("meddra_all_se.tsv*",), _tsv("stitch_flat", "stitch_stereo", "umls_label", "concept_type", "umls_meddra", "name")), "terms": Input(("meddra.tsv*",), lambda s, p: ragged(s, p, ["umls_cui", "concept_type", "meddra_id", "name"], with_ordinal=True))}, {"chemical_causes_effect": _texts("pubchem_cid meddra_id source_database")}),
    ("bindingdb", tables.bindingdb, {"measurements": Input(("BindingDB_All*.tsv",), _named(renamed={"DrugBank ID of Ligand": "drugbank_id", "UniProt (SwissProt) Primary ID of Target Chain": "uniprot_id", "Target Source Organism According to Curator or DataSource": "organism"})), "id_map": Input(("HUMAN_9606_idmapping_selected.tab*",), lambda s, p: ragged(s, p, ["uniprot_id", "_name", "ncbi_gene_id"], least=3))}, {"drug_binds_gene": _texts("drugbank_id ncbi_gene_id source_database")}),
    ("drugbank", _drugbank_plan, {"drugs": Input(("full_database.xml",), lambda s, p: readers.xml_rows(s, p, "drug", tables.DRUG_XML), required=False), "links": Input(("drugs.csv",), _named(sep=","), required=False)},
     {"drugs": _texts("drugbank_id drug_name drugDescription drugType drugGroups drugCategories drugIndication drugPharmacology drugMechanism drugToxicity drugHalfLife drugState molecularFormula molecularWeight smiles inchi inchikey cas_number kegg_drug_id pubchem_cid chembl_id chebi_id source_database"), "drug_gene_edges": _texts("drugbank_id gene_symbol uniprot_id interaction_type source_database")}),
    ("drugcentral", tables.drugcentral, {k: Input((f"{k}.parquet", f"{k}"), _parquet) for k in ("structures", "identifier", "pharma_class", "omop", "faers")},
     {"drugs": "struct_id long, cas_number string, drug_name string, inchikey string, inchi string, smiles string, molecular_weight double, molecular_formula string, logp double, tpsa double, lipinski_compliance int, drugbank_id string, chebi_id string, pubchem_cid string, mesh_id string, umls_cui string, source_database string", "pharmacologic_classes": _texts("pharma_class_id pharma_class_name pharma_class_code source_database"), "drug_in_class": "struct_id long, pharma_class_id string, source_database string", "drug_treats_disease": "struct_id long, disease_id string, indication string, source_database string", "chemical_causes_effect": "struct_id long, adverse_effect_id string, adverse_effect_name string, llr double, drug_ae long, source_database string"}),
    ("aopdb", tables.aopdb, {"pathway_gene": Input(("pathway_gene.parquet", "pathway_gene"), _parquet), "chemical_info": Input(("chemical_info.parquet", "chemical_info"), _parquet)},
     {"pathways": _texts("path_name path_id ext_source path_iri source_database"), "gene_pathway_relationships": "entrez long, path_id string, path_name string, source_database string", "drugs": _texts("ChemicalID ChemicalName DTX_id source_database")}),
    ("medline", tables.medline, {"entity_docs": Input(("pmids/*.txt*",), lambda s, p: _pmids(s, p.rsplit("/", 1)[0])), "diseases": Input(("diseases.tsv",), _named()), "symptoms": Input(("symptom_nodes.tsv",), _named()), "anatomy": Input(("uberon_nodes.tsv",), _named())},
     {"disease_symptom_cooccurrence": f"doid_code string, mesh_id string, {_PAIR}, source_mesh string, source_database string", "disease_anatomy_cooccurrence": f"doid_code string, uberon_id string, {_PAIR}, source_mesh string, target_mesh string, source_database string", "disease_disease_cooccurrence": f"doid_code_0 string, doid_code_1 string, {_PAIR}, mesh_id_0 string, mesh_id_1 string, source_database string"}),
)
