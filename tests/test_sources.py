"""Literal rows in the layout of each source."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.sources import obo, readers
from weftline.sources import tables as t


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


OBO = """format-version: 1.2

[Term]
id: DOID:4
name: disease

[Term]
id: DOID:7
name: broad
is_a: DOID:4 ! disease

[Term]
id: DOID:9
name: Deep fever
def: "A fever [rare] that has_symptom rash, has_symptom cough." [url:x]
subset: uberon_slim
synonym: "hot one" EXACT [a]
xref: UMLS_CUI:C0000001
xref: MESH:D009
xref: SNOMEDCT_US_2020:77
xref: ICD10:A1 "text"
is_a: DOID:12 ! mid
relationship: part_of DOID:4 ! disease

[Term]
id: DOID:12
name: mid
is_a: DOID:7 ! broad

[Term]
id: DOID:99
name: gone
is_obsolete: true

[Typedef]
id: part_of
"""


def terms(spark, tmp_path, text=OBO, name="x.obo"):
    p = tmp_path / name
    p.write_text(text)
    return obo.terms(spark, str(p))


def test_obo_and_disease_ontology(spark, tmp_path):
    o = terms(spark, tmp_path)
    assert rows(o, "id", "is_obsolete") == {("DOID:4", False), ("DOID:7", False), ("DOID:9", False), ("DOID:12", False), ("DOID:99", True)}
    assert rows(t.depth_below(o, "DOID:4"), "id", "depth") == {("DOID:4", 0), ("DOID:7", 1), ("DOID:12", 2), ("DOID:9", 3)}
    d = t.disease_ontology(o)["slim_terms"]
    assert rows(d, "doid", "umls_cui", "mesh_id", "snomed_id", "symptoms") == {("DOID:4", "", "", "", ""), ("DOID:9", "C0000001", "D009", "77", "rash|cough")}
    assert rows(t.disease_ontology(o, scope={"terms": ["FEVER"]})["slim_terms"], "doid") == {("DOID:9",)}
    assert rows(obo.xref_pairs(o, "MESH:"), "id", "xref") == {("DOID:9", "D009")}


def test_mondo_hpo_uberon(spark, tmp_path):
    text = OBO.replace("DOID:", "MONDO:").replace("UMLS_CUI:", "UMLS:")
    m = t.mondo(terms(spark, tmp_path, text))["disease_nodes"].where("mondo_id = 'MONDO:9'")
    assert rows(m, "disease_name", "definition", "synonyms", "is_a", "umls_cui", "icd10cm", "mesh_id") == {("Deep fever", "A fever [rare] that has_symptom rash, has_symptom cough.", "hot one", "MONDO:12", "C0000001", "A1", "D009")}
    u = terms(spark, tmp_path, OBO.replace("DOID:", "UBERON:"))
    assert rows(t.uberon(u, u.where("id = 'UBERON:9'"))["uberon_nodes"], "uberon_id", "mesh_id", "is_human", "is_a", "part_of") == {("UBERON:9", "MESH:D009", 1, "UBERON:12", "UBERON:4")}
    ann = spark.createDataFrame([("OMIM:1", "", " HP:1 ", "IEA", "", "", ""), ("OMIM:1", "NOT", "HP:2", "IEA", None, "", ""), ("ORPHA:14", "", "HP:1", "x", "", "", ""), ("", "", "HP:9", "", "", "", "")], "database_id string, qualifier string, hpo_id string, evidence string, onset string, frequency string, sex string")
    med = spark.createDataFrame([("C1", "n", "1", "OMIM", 1), ("C2", "n", "1", "OMIM", 2), ("C3", "n", "Orphanet_14", "Orphanet", 3)], "cui string, pref string, source_id string, source string, _ord int")
    h = t.hpo(None, ann, med)
    assert rows(h["disease_phenotype_positive"], "hp_id", "cui") == {("HP:1", "C2"), ("HP:1", "C3")} and rows(h["disease_phenotype_negative"], "hp_id", "cui") == {("HP:2", "C2")}


def test_readers(spark, tmp_path):
    p = tmp_path / "a.gaf"
    p.write_text("!c\na\tb\tc\nx\n1\t2\n")
    assert rows(readers.ragged(spark, str(p), ["u", "v", "w"], least=2, skip="!"), "u", "v", "w") == {("a", "b", "c"), ("1", "2", "")}
    assert tuple(readers.count_bad_rows(spark, str(p), 3).first()) == (4, 3)
    with gzip.open(tmp_path / "l.txt.gz", "wt") as f:
        f.write("protein1 protein2 combined_score\n9606.A 9606.B 700\n")
    assert rows(readers.delimited(spark, str(tmp_path / "l.txt.gz"), ["a", "b", "s"], sep=" ", header=True), "a", "b", "s") == {("9606.A", "9606.B", "700")}
    c = tmp_path / "c.tsv"
    c.write_text("# note\nx\ty\n1\t\n")
    assert rows(readers.delimited(spark, str(c), ["a", "b"], comment="#"), "a", "b") == {("x", "y"), ("1", None)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/data.tsv", "l1\nl2\n")
        z.writestr("other.bin", "no")
    assert rows(readers.zip_members(spark, str(tmp_path / "z.zip"), r"\.tsv$"), "member", "line_no", "line") == {("in/data.tsv", 0, "l1"), ("in/data.tsv", 1, "l2")}
    (tmp_path / "pm").mkdir()
    (tmp_path / "pm" / "D01.txt").write_text("5\n7\n\n")
    assert rows(readers.id_per_file(spark, str(tmp_path / "pm" / "*.txt")), "entity_id", "doc") == {("D01", "5"), ("D01", "7")}
    assert readers.first_existing(spark, str(tmp_path), ["no", "a.gaf"]).endswith("/a.gaf") and readers.first_existing(spark, str(tmp_path), ["no"]) is None and readers.either_source((None, len), ("x", lambda v: {v: 1})) == {"x": 1}
    x = tmp_path / "m.xml"
    x.write_text("<R><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Pain</String></DescriptorName><TreeNumberList><TreeNumber>C23.888.1</TreeNumber></TreeNumberList></DescriptorRecord><DescriptorRecord><DescriptorUI>D2</DescriptorUI><DescriptorName><String>Root</String></DescriptorName><TreeNumberList><TreeNumber>C23.888</TreeNumber></TreeNumberList></DescriptorRecord></R>")
    m = readers.xml_rows(spark, str(x), "DescriptorRecord", "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>").select(F.col("DescriptorUI").alias("mesh_id"), F.col("DescriptorName.String").alias("mesh_name"), F.col("TreeNumberList.TreeNumber").alias("tree_numbers"))
    assert rows(t.mesh(m)["symptom_nodes"], "mesh_id", "mesh_name") == {("D1", "Pain")}


def test_genes_and_interactions(spark):
    g = spark.createDataFrame([("9606", 1, "A1BG", "-", "MIM:138670|HGNC:HGNC:5|Ensembl:E1", "19", "alpha", "pc", "f"), ("9606", 2, "LOC12", "-", "Ensembl:E2", "1", "x", "pc", "-"), ("10090", 3, "M", "-", "-", "1", "x", "pc", "-"), ("9606", 4, "B-AS1", "-", "Ensembl:E4|MIM:4", "1", None, "nc", "-")], "tax_id string, GeneID int, Symbol string, Synonyms string, dbXrefs string, chromosome string, description string, type_of_gene string, Full_name_from_nomenclature_authority string")
    w = t.widen(t.ncbigene(g)["genes"], "xrefs", "xref_", ["MIM", "HGNC", "Ensembl"])
    assert rows(w, "GeneID", "xref_MIM", "xref_HGNC", "xref_Ensembl") == {(1, "138670", "HGNC:5", "E1"), (2, None, None, None), (4, "4", None, None)}
    al = spark.createDataFrame([("9606.A", "11", "KEGG_GENEID"), ("9606.A", "10", "Ensembl_HGNC_entrez_id"), ("9606.B", "20", "UniProt_DR_GeneID"), ("9606.C", "x", "other")], "string_protein_id string, alias string, source string")
    li = spark.createDataFrame([("9606.A", "9606.B", 700), ("9606.B", "9606.A", 999), ("9606.A", "9606.B", 699), ("9606.A", "9606.C", 900)], "protein1 string, protein2 string, combined_score int")
    assert rows(t.string_ppi(li, al)["gene_interactions"], "gene_id_1", "gene_id_2", "combined_score") == {("10", "20", 700), ("20", "10", 999)}
    b = spark.createDataFrame([("G1", "UBERON:1", "present", "gold", "0.01", "90.1", "5"), ("G2", "UBERON:1", "present", "gold", "0.01", "90.0", "5"), ("G3", "CL:1", "present", "gold", "0", "99", "5"), ("G4", "UBERON:1", "absent", "g", "0", "99", "1"), ("G5", "UBERON:2", "present", "g", "0", "NaN", "1")], "gene_id string, anatomical_entity_id string, expression string, call_quality string, fdr string, expression_score string, expression_rank string")
    assert rows(t.bgee(b)["anatomy_expresses_gene"], "ensembl_gene_id") == {("G1",)}
    i = spark.createDataFrame([("p", "q", "TF", "G", True, True, False, 1, "A;D"), ("p", "q", "TF", "H", True, True, True, 1, "E"), ("p", "q", "T2", "H", True, False, True, 1, "B")], "source string, target string, source_genesymbol string, target_genesymbol string, is_directed boolean, is_stimulation boolean, is_inhibition boolean, curation_effort int, dorothea_level string")
    assert rows(t.dorothea(i, ["A", "B"])["tf_gene_interactions"], "tf_symbol", "mode_of_regulation", "mor_score") == {("TF", "activation", 1), ("T2", "repression", -1)}
    gaf = spark.createDataFrame([("UniProtKB", "S", "involved_in", "GO:1", "IEA", "P", "taxon:9606"), ("UniProtKB", "S", "", "GO:1", "IDA", "P", "taxon:9606"), ("UniProtKB", "S", "NOT|x", "GO:2", "IDA", "P", "taxon:9606"), ("RNA", "S", "", "GO:3", "IDA", "P", "taxon:9606")], "DB string, DB_Object_Symbol string, Qualifier string, GO_ID string, Evidence_Code string, Aspect string, Taxon string")
    o = spark.createDataFrame([("GO:1", "n", '"d" [x]', "biological_process", False)], "id string, name string, def string, namespace string, is_obsolete boolean")
    go = t.gene_ontology(o, gaf)
    assert rows(go["gene_bp_associations"], "gene_symbol", "go_id", "evidence") == {("S", "GO:1", "IDA")} and rows(go["biological_process_nodes"], "go_id", "definition") == {("GO:1", "d")}
    m = spark.createDataFrame([(0, [0.0, 11.0, 10.0, 20.0]), (1, [11.0, 0.0, float("nan"), 12.0]), (2, [0.0, 0.0, 0.0, 30.0])], "i int, scores array<double>")
    assert rows(t.rate_covariation(m, ["a", "b", "c", ""])["gene_covariation"], "source_hgnc", "target_hgnc") == {("a", "b")}


def test_chemicals_and_drugs(spark, tmp_path):
    c = spark.createDataFrame([("chem", "C1", "7", "t", "9606", "increases^expression|affects^binding", "1|2", 1), ("other", "MESH:C1", "8", None, None, "decreases^expression", None, 2), ("n", None, "7", "", "", "increases^expression", "", 3), ("n", "C2", "", "", "", "increases^expression", "", 4)], "ChemicalName string, ChemicalID string, GeneID string, Interaction string, OrganismID string, InteractionActions string, PubMedIDs string, _ord int")
    v = spark.createDataFrame([("MESH:C1", "50-0", "CID:C12", "DTX", "KEY", "P")], "ChemicalID string, CasRN string, PubChemCID string, DTXSID string, InChIKey string, ParentIDs string")
    out = t.ctd_chemical(c, v)
    assert rows(out["chemical_increases_expression"], "chemical_id", "gene_id", "pubmed_id") == {("MESH:C1", "7", "1|2")} and rows(out["chemical_decreases_expression"], "gene_id", "organism") == {("8", "")}
    assert rows(out["chemical_nodes"], "chemical_name", "pubchem_cid", "cas_number") == {("chem", "12", "50-0")}
    e = spark.createDataFrame([("As^D1^MESH|Cd^D2^MESH| ^ ^", "TP53^gene^7157^x|r^chem^1", "flu^D9^M|x^ ", "go^GO:1^GO", " 5 ")], "Stressors string, Receptors string, Diseases string, GOTerms string, PubmedID string")
    x = t.ctd_exposure(e, spark.createDataFrame([("GO:1", "biological_process")], "go_id string, namespace string"))
    assert rows(x["exposure_linked_to_disease"], "xrefMeSH", "disease_id", "pubmedId") == {("D1", "D9", "5"), ("D2", "D9", "5")} and rows(x["exposure_interacts_with_gene"], "xrefMeSH", "xrefNcbiGene") == {("D1", "7157"), ("D2", "7157")}
    assert x["exposure_interacts_with_biological_process"].count() == 2 and x["exposure_nodes"].count() == 2
    s = t.sider(spark.createDataFrame([("CID100002441", "x", "u", "PT", "C1", "n"), ("CID100002441", "x", "u", "LLT", "C1", "n"), ("bad", "x", "u", "PT", "C1", "n")], "stitch_flat string, stitch_stereo string, umls_label string, concept_type string, umls_meddra string, name string"), spark.createDataFrame([("C1", "PT", "100", "n"), ("C1", "LLT", "200", "n")], "umls_cui string, concept_type string, meddra_id string, name string"))
    assert rows(s["chemical_causes_effect"], "pubchem_cid", "meddra_id") == {("2441", "100")}
    b = t.bindingdb(spark.createDataFrame([("DB1", "P1", "Homo sapiens", 1), ("DB2", "P1", "Mouse", 2), ("DB2", "P1", "Homo sapiens", 3), ("NULL", "P1", "Homo sapiens", 4)], "drugbank_id string, uniprot_id string, organism string, _ord int"), spark.createDataFrame([("P1", "9"), ("P1", "10"), ("P2", "-")], "uniprot_id string, ncbi_gene_id string"))
    assert rows(b["drug_binds_gene"], "drugbank_id", "ncbi_gene_id") == {("DB1", "10")}
    p = tmp_path / "d.xml"
    p.write_text("""<drugbank><drug type="small molecule"><drugbank-id primary="true">DB1</drugbank-id><drugbank-id>X</drugbank-id><name>N
 m</name><cas-number>50-0</cas-number><groups><group>approved</group><group>old</group></groups><calculated-properties><property><kind>SMILES</kind><value>C</value></property><property><kind>SMILES</kind><value>CC</value></property></calculated-properties>
<external-identifiers><external-identifier><resource>ChEBI</resource><identifier>7</identifier></external-identifier></external-identifiers><targets><target><polypeptide id="P1"><gene-name>G1</gene-name></polypeptide></target><target></target></targets><enzymes><enzyme><polypeptide id="P2"><gene-name></gene-name></polypeptide></enzyme></enzymes></drug>
<drug type="biotech"><drugbank-id primary="true">DB2</drugbank-id><name>no reference</name></drug></drugbank>""")
    d = t.drugbank(readers.xml_rows(spark, str(p), "drug", t.DRUG_XML))
    assert rows(d["drugs"], "drugbank_id", "drug_name", "drugGroups", "smiles", "chebi_id", "cas_number") == {("DB1", "N  m", "approved; old", "CC", "7", "50-0")}
    assert rows(d["drug_gene_edges"], "drugbank_id", "gene_symbol", "uniprot_id", "interaction_type") == {("DB1", "G1", "P1", "target"), ("DB1", "", "P2", "enzyme")}
    links = spark.createDataFrame([("DB1", "n", "50-0"), ("DB2", "n", " ")], ["DrugBank ID", "Name", "CAS Number"])
    assert rows(t.drugbank_links(links)["drugs"], "drugbank_id", "smiles") == {("DB1", "")}


def test_sql_sources(spark):
    s = spark.createDataFrame([(1, "c", "n", "k", "i", "s", 1.0, "f", 0.1, 0.2, 0)], "id long, cas_reg_no string, name string, inchikey string, inchi string, smiles string, cd_molweight double, cd_formula string, clogp double, tpsa double, lipinski int")
    ids = spark.createDataFrame([(1, "CHEBI", "7"), (1, "CHEBI", "8"), (1, "UMLSCUI", "C1")], "struct_id long, id_type string, identifier string")
    pc = spark.createDataFrame([(1, "N1", "cl", None), (1, None, "cl", "FDA")], "struct_id long, class_code string, name string, source string")
    om = spark.createDataFrame([(1, "C1", "indication"), (1, "C2", "indication"), (1, "C1", "contraindication")], "struct_id long, umls_cui string, relationship_name string")
    fa = spark.createDataFrame([(1, "m", "n", 10.0, 5.0, 3), (1, "m2", "n", 10.0, 5.0, 2), (1, "m3", "n", 4.0, 5.0, 9)], "struct_id long, meddra_code string, meddra_name string, llr double, llr_threshold double, drug_ae long")
    d = t.drugcentral(s, ids, pc, om, fa, ["C1"])
    assert rows(d["drugs"], "struct_id", "chebi_id", "umls_cui", "drugbank_id") == {(1, "8", "C1", None)} and rows(d["pharmacologic_classes"], "pharma_class_id") == {("DC:N1",)}
    assert rows(d["drug_treats_disease"], "disease_id") == {("C1",)} and rows(d["chemical_causes_effect"], "adverse_effect_id") == {("m",)}
    pg = spark.createDataFrame([(1, "p2", "A<i>x</i> - Homo sapiens (human)", "KEGG", 9606), (1, "p1", "Ax", "R", 9606), (2, "p3", "B", "R", 10090)], "entrez long, path_id string, path_name string, ext_source string, tax_id int")
    a = t.aopdb(pg, spark.createDataFrame([("c",)], "ChemicalName string"))
    assert rows(a["pathways"], "path_name", "path_id", "ext_source", "path_iri") == {("Ax", "p1,p2", "AOPDB - KEGG,R", "ax")} and a["gene_pathway_relationships"].count() == 2


def test_pages_articles_and_slim(spark, tmp_path):
    p = tmp_path / "page.json"
    item = {"geneNcbiID": 5, "symbolOfGene": "G", "geneEnsemblIDs": ["E1", "E2"], "geneProteinStrIDs": [], "diseaseUMLSCUI": "C1", "diseaseName": "n", "diseaseType": "d", "diseaseClasses_MSH": ["a", "b"], "diseaseClasses_UMLS_ST": [], "score": 0.5, "ei": 1.0, "numPMIDs": 3, "diseaseVocabularies": ["MESH_D1", "MESH_D2", "DO_9"]}
    p.write_text(json.dumps({"payload": [item, item]}))
    schema = "geneNcbiID long, symbolOfGene string, geneEnsemblIDs array<string>, geneProteinStrIDs array<string>, genepLI double, geneDSI double, geneDPI double, diseaseUMLSCUI string, diseaseName string, diseaseType string, diseaseClasses_MSH array<string>, diseaseClasses_UMLS_ST array<string>, score double, ei double, numPMIDs long, diseaseVocabularies array<string>"
    from pyspark.sql.types import StructType

    g = t.disgenet(readers.json_pages(spark, str(p), StructType.fromDDL(schema)))
    assert rows(g["genes"], "geneId", "ensemblId", "proteinId") == {("5", "E1", None)} and rows(g["diseases"], "MSH", "DO", "diseaseClass", "diseaseSemanticType") == {("D1", "DOID:9", "a; b", None)} and g["gene_disease_associations"].count() == 1
    docs = spark.createDataFrame([("D1", 1), ("D1", 2), ("S1", 1), ("A1", 2), ("D2", 1), ("D1", 1)], "mesh_id string, doc long")
    dis = spark.createDataFrame([("x", "D1"), ("y", "MESH:D2"), ("z", "D1")], "doid_code string, mesh_id string")
    m = t.medline(docs, dis, spark.createDataFrame([("S1",)], "mesh_id string"), spark.createDataFrame([("U1", "MESH:A1")], "uberon_id string, mesh_id string"))
    assert rows(m["disease_symptom_cooccurrence"], "doid_code", "mesh_id", "cooccurrence", "source_mesh") == {("x", "S1", 1, "D1"), ("y", "S1", 1, "D2"), ("z", "S1", 1, "D1")}
    assert rows(m["disease_disease_cooccurrence"], "doid_code_0", "doid_code_1", "cooccurrence") == {("x", "y", 1), ("x", "z", 2), ("y", "z", 1)}
    do = terms(spark, tmp_path)
    mo = spark.createDataFrame([("MONDO:01", False, ["DOID:9", "X:1"])], "id string, is_obsolete boolean, xref array<string>")
    st = spark.createDataFrame([(f"http://o/MONDO_01, http://o/EFO_{k}", f"s{k}") for k in range(3)], "trait_uris string, study string")
    sl = t.slim_terms(spark.createDataFrame([("DOID:7", "b"), ("DOID:404", "no")], "doid string, name string"), spark.createDataFrame([("DOID:7", "cancer")], "doid string, name string"), st, mo, do, 2)
    assert [tuple(r) for r in sl.collect()] == [("DOID:7", "cancer"), ("DOID:9", "Deep fever")]


def test_obo_with_other_line_ends(spark, tmp_path):
    want = rows(terms(spark, tmp_path), "id", "name", "is_obsolete")
    crlf = tmp_path / "crlf.obo"
    crlf.write_bytes(OBO.replace("\n", "\r\n").encode())
    tight = tmp_path / "tight.obo"
    tight.write_text(OBO.replace("\n\n", "\n"))
    assert len(want) == 5 and rows(obo.terms(spark, str(crlf)), "id", "name", "is_obsolete") == want == rows(obo.terms(spark, str(tight)), "id", "name", "is_obsolete")


def test_more_readers(spark, tmp_path):
    p = tmp_path / "c.tsv"
    p.write_text("a\tb\n1\t2\n3\n4\t5\t6\n#no\ty#z\n")
    assert rows(readers.well_formed(spark, str(p), ["a", "b"], header=True), "a", "b") == {("1", "2"), ("3", None), ("#no", "y#z")}
    assert rows(readers.ragged(spark, str(p), ["a", "b"], cut_at="#"), "a", "b") == {("a", "b"), ("1", "2"), ("3", ""), ("4", "5")}
    m = tmp_path / "m.csv"
    m.write_text(",g1,g2,g3\ng1,0,11,x\ng2,11,0,12\ng3,1,12,0\n")
    wide, labels = readers.wide_matrix(spark, str(m))
    assert rows(t.rate_covariation(wide, labels)["gene_covariation"], "source_hgnc", "target_hgnc", "erc_score") == {("g1", "g2", 11.0), ("g2", "g3", 12.0)}
    for name, text in (("nodes_Gene", "id,name\ng1,a\n"), ("nodes_Drug", "id,name\nd1,b\n"), ("edges_binds", "start_id,end_id\nd1,g1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    found = readers.typed_tables(spark, str(tmp_path), "nodes")
    assert set(found) == {"Gene", "Drug"} and rows(found["Gene"], "id", "name") == {("g1", "a")}
    hits = spark.createDataFrame([("t1", 2, "C2"), ("t1", 1, "C1"), ("t2", 3, "C1"), ("t2", 4, "")], "term string, n int, cui string")
    assert rows(readers.search_ids(hits, "term", "n", "cui"), "cui", "term", "rank") == {("C1", "t1", 1), ("C2", "t1", 2)}


RDF_TEXT = """<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [<!ENTITY xsd "http://www.w3.org/2001/XMLSchema#" >]>
<rdf:RDF xmlns="http://o/kg#" xml:base="http://o/kg" xmlns:kg="http://o/kg#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
<owl:Ontology rdf:about="http://o/kg"/>
<owl:Class rdf:about="#Gene"/>
<owl:NamedIndividual rdf:about="#bare"/>
<owl:NamedIndividual rdf:about="#gene_1"><rdf:type rdf:resource="#Gene"/><kg:name rdf:datatype="&xsd;string">A &lt; B</kg:name><kg:binds rdf:resource="http://o/kg#drug_1"/></owl:NamedIndividual>
<owl:NamedIndividual rdf:about="http://o/kg#drug_1"><rdf:type rdf:resource="#Drug"/></owl:NamedIndividual>
</rdf:RDF>
"""


def test_individuals_of_an_rdf_file(spark, tmp_path):
    from weftline.graph import build

    p = tmp_path / "kg.rdf"
    p.write_text(RDF_TEXT)
    tr = readers.rdf_individuals(spark, str(p))
    assert {(r.id, r.node_type, str(r.props)) for r in build.triple_nodes(tr).collect()} == {("gene_1", "Gene", "{'name': ['A < B']}"), ("drug_1", "Drug", "{}")}
    assert [tuple(r) for r in build.triple_edges(tr).collect()] == [("binds", "gene_1", "drug_1")]
    assert build.main_namespace(tr).first().namespace == "http://o/kg#"


def test_a_run_over_a_landing_folder(spark, tmp_path):
    from weftline.sources import registry

    assert len(registry.REGISTRY) == 22
    for source, name, text in (
        ("reactome", "ReactomePathways.txt", "R1\tP\tHomo sapiens\nR2\tQ\tMus musculus\n"), ("reactome", "NCBI2Reactome_All_Levels.txt", "7\tR1\tu\tP\tTAS\tHomo sapiens\n7\tR1\tu\tP\tTAS\tHomo sapiens\n"),
        ("collectri", "tf_gene_interactions.tsv", "source_genesymbol\ttarget_genesymbol\tis_directed\tis_stimulation\tis_inhibition\tconsensus_direction\tconsensus_stimulation\tconsensus_inhibition\nTF\tG\t1\t1\t0\t1\t1\t0\n\tG\t1\t1\t0\t1\t1\t0\n"),
        ("mondo", "mondo.obo", OBO.replace("DOID:", "MONDO:")), ("bad", "x", ""),
    ):
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / name).write_text(text)
    config = {"reactome": {"enabled": True}, "collectri": {"enabled": True}, "mondo": {"enabled": True}, "mesh": {"enabled": False}, "sider": {"enabled": True}, "string": {"enabled": True, "args": {"min_score": "x"}}, "nowhere": {"enabled": True}}
    done, failed = registry.run(spark, str(tmp_path), config, {"scope": {"terms": ["fever"]}})
    assert set(failed) == {"nowhere"} and set(done) == {"reactome", "collectri", "mondo", "sider", "string"}
    assert rows(done["reactome"]["pathways"], "reactome_id") == {("R1",)} and done["reactome"]["ncbi_gene_pathway_relationships"].count() == 1
    assert rows(done["collectri"]["tf_gene_interactions"], "tf_symbol", "target_gene", "is_directed") == {("TF", "G", 1)} and rows(done["mondo"]["disease_nodes"], "mondo_id") == {("MONDO:9",)}
    empty = done["string"]["gene_interactions"]
    assert empty.count() == 0 and dict(empty.dtypes)["combined_score"] == "bigint"
    registry.write_tables({"mondo": done["mondo"], "sider": done["sider"]}, str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "out/mondo/disease_nodes.tsv")).count() == 1
    with pytest.raises(ValueError):
        registry.register(registry.REGISTRY["mesh"])


def test_declared_outputs_are_those_of_the_plans(spark):
    """Every plan run on empty inputs makes tables of the declared columns."""
    from weftline.sources import registry

    g = spark.createDataFrame([], "DB string, DB_Object_Symbol string, Qualifier string, GO_ID string, Evidence_Code string, Aspect string, Taxon string")
    o = spark.createDataFrame([], "id string, name string, def string, namespace string, is_obsolete boolean, subset array<string>, xref array<string>, synonym array<string>, is_a array<string>, relationship array<string>")
    for name, given in (("gene_ontology", {"obo": o, "gaf": g}), ("mondo", {"obo": o}), ("uberon", {"basic": o, "human": o}), ("hpo", {"obo": o})):
        s = registry.REGISTRY[name]
        for k, df in s.tables(spark, given).items():
            assert set(df.columns) == {f.name for f in spark.createDataFrame([], s.outputs[k]).schema}, (name, k)


def test_registered_functions(spark):
    from weftline.functions.registered import register

    def shout(word: str, times: int = 1) -> list[str]:
        return [word.upper()] * times

    assert register(spark, shout) == {"word": "string", "times": "bigint"}
    assert spark.sql("select shout('a', 2) as r").first().r == ["A", "A"]
    with pytest.raises(TypeError):
        register(spark, lambda x: x)


def test_catalog_view(spark):
    from weftline.graph import catalog_view as cv
    from weftline.graph.export import with_json

    rec = spark.createDataFrame([("d1", " L ", "Direct", "Yes", "", "", " ", "Gene, Disease,x", "binds"), ("d2", None, "New", "no", "TBD", "3", "d1", "Drug", None), ("", "n", "New", "Yes", "", "", "", "", "")], ["ID", "Label", "Integration Path", "Active", "Status", "Latest Version", "Sub-source Of", "Biomedical Entities (Node types)", "Biomedical Relationships (Edge types)"])
    c = cv.records(rec, {"Gene": "nt_G", "Disease": "nt_D", "Drug": "nt_R"}, {"binds": "et_b"})
    assert sorted((r.id, r.label, r.active, r.status, r.version, r.parent, tuple(r.nodes), tuple(r.edges)) for r in c.collect()) == [("d1", "L", True, "N/A", "N/A", None, ("nt_G", "nt_D"), ("et_b",)), ("d2", "", False, "TBD", "3", "d1", ("nt_R",), ())]
    f = cv.facet_counts(c, ["Direct", "Hetionet", "New"]).first()
    assert (f.Direct, f.Hetionet, f.New, f.active_yes, f.active_no, f.status_TBD, f.status_obsolete) == (1, 0, 1, 1, 1, 1, 1)
    links = spark.createDataFrame([("d1", "nt_G"), ("d2", "nt_R"), ("d2", "d1")], "source string, target string")
    assert rows(cv.visible_links(links, c, cv.is_visible(["Direct"])), "source", "target") == {("d1", "nt_G")}
    assert rows(cv.inactive_types(c, cv.is_visible(["Direct", "New"])), "type") == {("nt_R",)} and rows(cv.inactive_types(c, cv.is_visible([])), "type") == {("nt_G",), ("nt_D",), ("et_b",), ("nt_R",)}
    assert 'const D = [' in with_json("x /*here*/ y", "/*here*/", "D", c)
    with pytest.raises(ValueError):
        with_json("x", "/*here*/", "D", c)


def test_jdbc_scan(spark):
    """A query pushed to an embedded database."""
    from pyspark.errors import PySparkException

    url, driver = "jdbc:derby:memory:sources;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(i, f"n{i % 3}") for i in range(20)], "struct_id int, name string")
    try:
        df.write.format("jdbc").options(url=url, dbtable="omop", **driver).save()
    except PySparkException as e:
        pytest.skip(f"no embedded database: {str(e)[:60]}")
    got = readers.jdbc_query(spark, url, 'select "struct_id", "name" from omop where "struct_id" > 9', **driver)
    assert rows(got, "struct_id", "name") == {(i, f"n{i % 3}") for i in range(10, 20)}
