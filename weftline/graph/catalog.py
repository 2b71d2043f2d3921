"""The type catalog of an ontology: classes, object and data properties.

Ontology files are schema-sized and read on the driver; what comes out are
small DataFrames that queries join.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_R = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_S = "{http://www.w3.org/2000/01/rdf-schema#}"
_O = "{http://www.w3.org/2002/07/owl#}"


def _local(iri: str | None) -> str | None:
    return None if not iri else iri.rsplit("#", 1)[-1] if "#" in iri else iri.rsplit("/", 1)[-1]


@dataclass
class Catalog:
    """classes: name -> direct superclasses; objects: name -> (domains, ranges, inverse); data: name -> range."""

    classes: dict[str, set[str]] = field(default_factory=dict)
    objects: dict[str, tuple[set[str], set[str], str | None]] = field(default_factory=dict)
    data: dict[str, str | None] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Catalog:
        """From RDF/XML. Superclasses also come from equivalentClass/intersectionOf members."""
        c = cls()
        for e in ET.parse(path).getroot():
            name = _local(e.get(f"{_R}about") or e.get(f"{_R}ID"))
            if not name:
                continue
            refs = lambda tag: {x for y in e.iter(tag) if (x := _local(y.get(f"{_R}resource")))}  # noqa: B023, E731
            if e.tag == f"{_O}Class":
                up = {x for y in e.findall(f"{_S}subClassOf") if (x := _local(y.get(f"{_R}resource")))}
                for member in e.findall(f"{_O}equivalentClass//{_O}intersectionOf/*"):
                    if x := _local(member.get(f"{_R}about") or member.get(f"{_R}resource")):
                        up.add(x)
                c.classes.setdefault(name, set()).update(up)
            elif e.tag == f"{_O}ObjectProperty":
                c.objects[name] = (refs(f"{_S}domain"), refs(f"{_S}range"), next(iter(refs(f"{_O}inverseOf")), None))
            elif e.tag == f"{_O}DatatypeProperty":
                c.data[name] = next(iter(refs(f"{_S}range")), None)
        return c

    def names(self) -> set[str]:
        return {*self.classes, *self.objects, *self.data}

    def add_class(self, name: str, parent: str | None = None) -> None:
        self._new(name)
        if parent and parent not in self.classes:
            raise ValueError(f"no class {parent}")
        self.classes[name] = {parent} if parent else set()

    def add_object_property(self, name: str, domain: str, range_: str, inverse: str | None = None) -> None:
        self._new(name)
        for t in (domain, range_):
            if t not in self.classes:
                raise ValueError(f"no class {t}")
        self.objects[name] = ({domain}, {range_}, inverse)

    def add_data_property(self, name: str, range_: str = "string") -> None:
        self._new(name)
        self.data[name] = range_

    def remove(self, name: str) -> None:
        """Takes a name out, and every mention of it."""
        if name not in self.names():
            raise ValueError(f"no {name}")
        self.classes.pop(name, None)
        self.objects.pop(name, None)
        self.data.pop(name, None)
        for up in self.classes.values():
            up.discard(name)
        self.objects = {k: (d - {name}, r - {name}, None if i == name else i) for k, (d, r, i) in self.objects.items()}

    def _new(self, name: str) -> None:
        if name in self.names():
            raise ValueError(f"{name} is there already")

    def class_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, p) for k, up in self.classes.items() for p in (sorted(up) or [None])]
        return spark.createDataFrame(rows, "child string, parent string")

    def object_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, d, r, i) for k, (ds, rs, i) in self.objects.items() for d in (sorted(ds) or [None]) for r in (sorted(rs) or [None])]
        return spark.createDataFrame(rows, "name string, domain string, range string, inverse string")

    def listing(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(kind, name, declared, populated): declared types beside those with data."""
        rows = [("class", k) for k in self.classes] + [("relation", k) for k in self.objects]
        d = spark.createDataFrame(rows, "kind string, name string").withColumn("declared", F.lit(True))
        p = nodes.select(F.lit("class").alias("kind"), F.col("node_type").alias("name")).distinct().unionByName(edges.select(F.lit("relation").alias("kind"), F.col("rel_type").alias("name")).distinct()).withColumn("populated", F.lit(True))
        return d.join(p, ["kind", "name"], "full_outer").select("kind", "name", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("populated", F.lit(False)).alias("populated"))


def violations(edges: DataFrame, node_types: DataFrame, domain_range: DataFrame, superclasses: DataFrame) -> DataFrame:
    """Per relation, edges whose start is outside the domain plus edges whose end is
    outside the range. ``node_types(id, node_type)``, ``domain_range(rel_type,
    domain, range)`` (null: any), ``superclasses(child, ancestor)``, closed. Edges
    with unknown ends are not counted."""
    ok = superclasses.select("child", "ancestor").unionByName(superclasses.select(F.col("child"), F.col("child").alias("ancestor"))).unionByName(superclasses.select(F.col("ancestor").alias("child"), F.col("ancestor"))).distinct()
    t = node_types.groupBy("id").agg(F.max("node_type").alias("t"))
    e = edges.join(domain_range, "rel_type").join(t.select(F.col("id").alias("start_id"), F.col("t").alias("ts")), "start_id", "left").join(t.select(F.col("id").alias("end_id"), F.col("t").alias("te")), "end_id", "left")
    # Types are few: counted per combination first, judged afterwards.
    g = e.groupBy("rel_type", "domain", "range", "ts", "te").agg(F.count(F.lit(1)).alias("n"))
    a = ok.select(F.col("child").alias("ts"), F.col("ancestor").alias("domain"), F.lit(True).alias("start_ok"))
    b = ok.select(F.col("child").alias("te"), F.col("ancestor").alias("range"), F.lit(True).alias("end_ok"))
    g = g.join(a, ["ts", "domain"], "left").join(b, ["te", "range"], "left")
    bad = lambda o, t, d: (F.col(t).isNotNull() & F.col(d).isNotNull() & F.col(o).isNull() & (F.col(t) != F.col(d))).cast("int")
    return g.groupBy("rel_type").agg(F.sum(F.col("n") * (bad("start_ok", "ts", "domain") + bad("end_ok", "te", "range"))).alias("violations"))
