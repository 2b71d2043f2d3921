"""Reading delimited text, ragged text, XML, SQL and archives into DataFrames.

Every reader takes an explicit schema; nothing is inferred from data. Gzip is
read by the codec; a gzip file is one task, so scans of large ones should be
repartitioned by their consumer.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.storage import matching


def strings(*columns: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = "\t", header: bool = False, quote: str | None = None, comment: str | None = None) -> DataFrame:
    """Text with one separator; names are by position, a header line is skipped. Short
    rows are padded with null, surplus fields cut. Missing is null as in the file
    (empty fields); see functions.text.normalize_na for stand-ins."""
    r = spark.read.schema(strings(*columns)).option("sep", sep).option("header", str(header).lower()).option("enforceSchema", "true").option("quote", quote or "\u0000").option("mode", "PERMISSIVE")
    if comment:
        r = r.option("comment", comment)
    return r.csv(path)


def ragged(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = "\t", least: int = 1, skip: str | None = None, with_ordinal: bool = False, cut_at: str | None = None) -> DataFrame:
    """Lines split by hand: those that start with ``skip`` or have fewer than ``least``
    fields are dropped, others padded with "" or cut to the columns. With ``cut_at``
    a line ends before that mark wherever it stands (some readers take comments so)."""
    t = spark.read.text(path)
    if skip:
        t = t.where(~F.startswith("value", F.lit(skip)))
    if cut_at:
        # input_file_name() needs its scan: the line is cut within the same projection.
        t = t.withColumn("value", F.substring_index("value", cut_at, 1)).where("value <> ''")
    parts = F.split("value", re.escape(sep), -1)
    t = t.select(parts.alias("p"), *([F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")).alias("_ord")] if with_ordinal else [])).where(F.size("p") >= least)
    return t.select(*[F.coalesce(F.try_element_at("p", F.lit(i + 1)), F.lit("")).alias(c) for i, c in enumerate(columns)], *(["_ord"] if with_ordinal else []))


def well_formed(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = "\t", header: bool = False) -> DataFrame:
    """Named columns of lines with at most that many fields: lines with more are skipped,
    short ones padded with null. ``header``: the line that holds the names is left out."""
    t = spark.read.text(path).select(F.split("value", re.escape(sep), -1).alias("f")).where(F.size("f") <= len(columns))
    if header:
        t = t.where(F.col("f") != F.array(*map(F.lit, columns)))
    return t.select(*[F.try_element_at("f", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


def wide_matrix(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, list[str]]:
    """(i, scores) of a square matrix in a delimited file whose header and first column are
    its labels, and the labels. Cells that are no number are null."""
    t = spark.read.option("sep", sep).option("header", "true").csv(path)
    labels = t.columns[1:]
    at = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, i)])
    return t.select(at[F.col(f"`{t.columns[0]}`")].alias("i"), F.array(*[F.col(f"`{c}`").try_cast("double") for c in labels]).alias("scores")).where("i is not null"), labels


def count_bad_rows(spark: SparkSession, path: str, n_fields: int, sep: str = "\t") -> DataFrame:
    """One row: lines, and lines whose number of fields differs."""
    t = spark.read.text(path)
    return t.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size(F.split("value", re.escape(sep), -1)) != n_fields).alias("n_bad"))


def select_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """One row per element with this tag, however deep, parsed in splits."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def jdbc_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query pushed to a database; options as for the jdbc source (numPartitions,
    partitionColumn with bounds for a parallel scan)."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def registered_tables(spark: SparkSession) -> set[str]:
    return {t.name for t in spark.catalog.listTables()}


def first_existing(spark: SparkSession, folder: str, names: Sequence[str]) -> str | None:
    """The first of several file names (or patterns) that exists in the landing folder, on
    whatever file system that is."""
    for n in names:
        found = matching(spark, f"{folder}/{n}")
        if found:
            return found[0]
    return None


def either_source(*choices: tuple[str | None, Callable[[str], dict[str, DataFrame]]]) -> dict[str, DataFrame]:
    """The result of the first choice whose path is there."""
    for path, read in choices:
        if path:
            return read(path)
    return {}


def zip_members(spark: SparkSession, path: str, pattern: str, encoding: str = "utf-8") -> DataFrame:
    """(archive, member, line_no, line) of the archive members whose name matches, one
    archive per task, members read as streams and passed on in batches of lines."""
    rx = re.compile(pattern)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in (x for x in z.namelist() if rx.search(x)):
                        with z.open(m) as f:
                            rows: list[tuple[str, str, int, str]] = []
                            for i, line in enumerate(io.TextIOWrapper(f, encoding=encoding, newline="\n")):
                                rows.append((at, m, i, line.rstrip("\r\n")))
                                if len(rows) >= 50_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "archive string, member string, line_no long, line string")


def id_per_file(spark: SparkSession, pattern: str, name: str = "entity_id") -> DataFrame:
    """(entity, doc) of files that hold one document id per line and are named after their entity."""
    base = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?(?:\.gz)?$", 1)
    return spark.read.text(pattern).select(base.alias(name), F.trim("value").alias("doc")).where("doc <> ''")


def typed_tables(spark: SparkSession, folder: str, kind: str) -> dict[str, DataFrame]:
    """The CSV files ``<kind>_<type>.csv`` (files or folders) of an exported graph, by type."""
    out = {}
    for p in matching(spark, f"{folder}/{kind}_*.csv"):
        name = p.rsplit("/", 1)[-1].removesuffix(".csv").removeprefix(f"{kind}_")
        out[name] = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(p)
    return out


def search_ids(pages: DataFrame, term: str, order: str, identifier: str) -> DataFrame:
    """(identifier, term, rank): ids of saved search results in the order in which they were
    first found; blank ids are left out. ``pages`` has one row per result."""
    x = pages.where(F.coalesce(F.trim(identifier), F.lit("")) != "").groupBy(identifier).agg(F.min(F.struct(order, term)).alias("m"))
    return x.select(identifier, F.col(f"m.{term}").alias(term), F.col(f"m.{order}").alias("rank"))


_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_OWL = "http://www.w3.org/2002/07/owl#"


def rdf_individuals(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_is_literal): the triples of the named individuals of an RDF/XML file, and
    that of its ontology. The file is split after each individual, so a large one is
    read in parallel; names are declared at its beginning, which the driver reads."""
    head = spark.read.option("wholetext", "false").text(path).limit(400).agg(F.array_join(F.collect_list("value"), "\n")).first()[0] or ""
    names = dict(re.findall(r'xmlns:?(\w*)\s*=\s*"([^"]*)"', head))
    entities = dict(re.findall(r'<!ENTITY\s+(\w+)\s+"([^"]*)"', head))
    base = (re.findall(r'xml:base\s*=\s*"([^"]*)"', head) or [""])[0]
    declared = " ".join(f'xmlns{":" + k if k else ""}="{v}"' for k, v in names.items())

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        full = lambda x: base + x if x.startswith("#") else x
        plain = lambda tag: tag[1:].replace("}", "", 1)
        for b in batches:
            rows: list[tuple[str, str, str, bool]] = []
            for text in b.column("value").to_pylist():
                for k, v in entities.items():
                    text = text.replace(f"&{k};", v)
                rows += [(full(x), _RDF + "type", _OWL + "Ontology", False) for x in re.findall(r'<owl:Ontology\s[^>]*rdf:about="([^"]*)"', text)]
                for one in re.split(r"<owl:NamedIndividual\b", text)[1:]:
                    # Individuals without content close themselves; the others end with their split.
                    alone = re.match(r"[^<>]*/>", one)
                    e = ET.fromstring(f"<r {declared}><owl:NamedIndividual{alone[0] if alone else one + '</owl:NamedIndividual>'}</r>")[0]
                    s = full(e.get(f"{{{_RDF}}}about") or "#" + (e.get(f"{{{_RDF}}}ID") or ""))
                    rows.append((s, _RDF + "type", _OWL + "NamedIndividual", False))
                    for c in e:
                        to = c.get(f"{{{_RDF}}}resource")
                        rows.append((s, plain(c.tag), c.text or "", True) if to is None else (s, plain(c.tag), full(to), False))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["s", "p", "o", "o_is_literal"])

    return spark.read.option("lineSep", "</owl:NamedIndividual>").text(path).mapInArrow(triples, "s string, p string, o string, o_is_literal boolean")


def json_pages(spark: SparkSession, path: str, payload: T.StructType) -> DataFrame:
    """The items of saved result pages, documents of the form {"payload": [...]}."""
    schema = T.StructType([T.StructField("payload", T.ArrayType(payload))])
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("payload").alias("p")).select("p.*")


def gt(c: Column | str, x: float) -> Column:
    """Greater than, in which NaN is not greater than anything."""
    c = F.col(c) if isinstance(c, str) else c
    return (c > x) & ~F.isnan(c)


def ge(c: Column | str, x: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c >= x) & ~F.isnan(c)
