"""Files as data: format detection, ontology headers, provenance triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.sources.jsondata import flatten_json

FS = "urn:filesystem:"


def detect_format(files: DataFrame) -> DataFrame:
    """Adds ``format`` to ``files(path, content)`` from the first bytes, then
    the extension; ``binaryFile`` tables have this shape.

    The cut may fall inside a character and the bytes may be in another
    encoding: what is not UTF-8 counts as replacement characters.
    """
    first = F.make_valid_utf8(F.substring(F.col("content"), 1, 8000).cast("string"))
    head = F.regexp_replace(F.substring(first, 1, 2000), r"^\s+", "")
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    xml = head.rlike(r"^<\?xml|^<!DOCTYPE|^<[A-Za-z_][^>]*\bxmlns[:=]")
    turtle = ext.isin("owl", "rdf", "xml") & head.rlike(r"(?i)^(@prefix|@base|PREFIX|BASE)\b")
    by_ext = (F.when(ext == "nt", "ntriples").when(ext == "nq", "nquads").when(ext == "trig", "trig")
              .when(ext == "jsonld", "jsonld").when(ext.isin("rdf", "xml", "owl"), "rdfxml").otherwise("turtle"))
    return files.withColumn("format", F.when(xml, "rdfxml").when(head.rlike(r"^[{\[]"), "jsonld").when(turtle, "turtle").otherwise(by_ext))


def ontology_info(quads: DataFrame, source: str = "source") -> DataFrame:
    """(source, iri, namespace): first declared ontology of each source."""
    heads = quads.filter((F.col("p") == m.TYPE) & (F.col("o") == m.OWL + "Ontology"))
    first = heads.groupBy(source).agg(F.min_by("s", F.struct("pos", "s")).alias("iri"))
    everyone = quads.select(source).distinct()
    named = F.when(~m.is_bnode(F.col("iri")), F.col("iri"))
    space = F.when(named.rlike("^https?:"), F.concat(F.regexp_replace(named, "[#/]$", ""), F.lit("#"))).otherwise("http://example.org/ontology#")
    return everyone.join(first, source, "left").select(source, named.alias("iri"), space.alias("namespace"))


def linked_files(quads: DataFrame) -> DataFrame:
    """(iri, target, path, name, image): the file that a resource is, or that
    its metadata observation describes."""
    described = quads.filter((F.col("p") == FS + "describes") & m.is_resource()).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("_d"))
    iris = quads.select(F.col("s").alias("iri")).unionAll(quads.filter(m.is_resource()).select("o")).distinct()
    target = F.coalesce("_d", "iri")
    rows = iris.join(described, "iri", "left").withColumn("target", target).filter(F.col("target").startswith("file:"))
    path = F.try_url_decode(F.replace(F.regexp_replace("target", "^file:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    rows = rows.withColumn("path", path).filter(F.col("path").startswith("/"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return rows.select("iri", "target", "path", name.alias("name"),
                       name.rlike(r"(?i)\.(png|jpe?g|gif|webp|bmp|tiff?|ico|avif)$").alias("image"))


def file_iri(path: Column) -> Column:
    encoded = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("file://"), encoded)


def files_to_prov(files: DataFrame, scan_id: str) -> DataFrame:
    """Provenance quads of ``files(path, parent, directory, observed, reparse,
    metadata, issues)``; ``metadata`` is JSON, its leaves become statements."""
    f = file_iri(F.col("path"))
    obs = F.concat(F.lit(f"urn:uuid:{scan_id}:observation:"), F.url_encode("path"), F.lit(":"), F.url_encode("observed"))
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    rows = files.withColumn("_f", f).withColumn("_o", obs).withColumn("_name", F.when(name != "", name).otherwise(F.col("path")))
    x, o = F.col("_f"), F.col("_o")
    flag = F.lit(m.XSD + "boolean")
    parts = [
        m.resource_quads(rows, x, F.lit(m.TYPE), F.lit(m.PROV + "Entity")),
        m.literal_quads(rows, x, F.lit(m.LABEL), F.col("_name")),
        m.literal_quads(rows, x, F.lit(FS + "path"), F.col("path")),
        m.resource_quads(rows, o, F.lit(m.TYPE), F.lit(m.PROV + "Entity")),
        m.literal_quads(rows, o, F.lit(m.LABEL), F.concat(F.lit("Metadata: "), F.col("_name"))),
        m.resource_quads(rows, o, F.lit(m.PROV + "wasGeneratedBy"), F.lit("urn:uuid:" + scan_id)),
        m.resource_quads(rows, o, F.lit(m.PROV + "wasDerivedFrom"), x),
        m.resource_quads(rows, o, F.lit(FS + "describes"), x),
        m.literal_quads(rows, o, F.lit(m.PROV + "generatedAtTime"), F.col("observed"), F.lit(m.XSD + "dateTime")),
        m.literal_quads(rows, o, F.lit(FS + "isReparsePoint"), F.col("reparse"), flag),
        m.resource_quads(rows.filter("directory"), x, F.lit(m.TYPE), F.lit(m.PROV + "Collection")),
        m.resource_quads(rows.filter("parent is not null"), file_iri(F.col("parent")), F.lit(m.PROV + "hadMember"), x),
        m.literal_quads(rows.select("_o", F.explode("issues").alias("issue")), o, F.lit(FS + "coverageIssue"), F.col("issue")),
        m.literal_quads(rows.filter("metadata is not null"), o, F.lit(FS + "raw"), F.col("metadata")),
    ]
    leaves = flatten_json(rows.filter("metadata is not null").select("_o", "metadata"), "_o", "metadata")
    parts.append(m.literal_quads(leaves, o, F.concat(F.lit(FS + "metadata:"), F.url_encode("path")), F.col("value"), F.col("datatype")))
    return reduce(DataFrame.unionByName, parts)


def run_to_prov(runs: DataFrame) -> DataFrame:
    """Activity and completion quads of ``runs(id, root, started, ended,
    status, entries, issues)``."""
    run, when = F.concat(F.lit("urn:uuid:"), "id"), F.lit(m.XSD + "dateTime")
    agent, whole = F.lit(FS + "collector"), F.lit(m.XSD + "integer")
    base = [
        m.resource_quads(runs, run, F.lit(m.TYPE), F.lit(m.PROV + "Activity")),
        m.literal_quads(runs, run, F.lit(m.LABEL), F.concat(F.lit("Filesystem observation: "), "root")),
        m.resource_quads(runs, run, F.lit(m.PROV + "wasAssociatedWith"), agent),
        m.literal_quads(runs, run, F.lit(m.PROV + "startedAtTime"), F.col("started"), when),
        m.literal_quads(runs, run, F.lit(FS + "selectedRoot"), F.col("root")),
        m.literal_quads(runs, run, F.lit(m.PROV + "endedAtTime"), F.col("ended"), when),
        m.literal_quads(runs, run, F.lit(FS + "completionStatus"), F.col("status")),
        m.literal_quads(runs, run, F.lit(FS + "entriesObserved"), F.col("entries"), whole),
        m.literal_quads(runs, run, F.lit(FS + "coverageIssues"), F.col("issues"), whole),
    ]
    once = runs.limit(1)
    fixed = [m.resource_quads(once, agent, F.lit(m.TYPE), F.lit(m.PROV + "SoftwareAgent"))]
    for c in ("Entity", "Activity", "Agent", "SoftwareAgent", "Collection"):
        fixed += [m.resource_quads(once, F.lit(m.PROV + c), F.lit(m.TYPE), F.lit(m.CLASS)),
                  m.literal_quads(once, F.lit(m.PROV + c), F.lit(m.LABEL), F.lit(c))]
    fixed += [m.resource_quads(once, F.lit(m.PROV + "SoftwareAgent"), F.lit(m.SUBCLASS), F.lit(m.PROV + "Agent")),
              m.resource_quads(once, F.lit(m.PROV + "Collection"), F.lit(m.SUBCLASS), F.lit(m.PROV + "Entity"))]
    return reduce(DataFrame.unionByName, base + fixed)
