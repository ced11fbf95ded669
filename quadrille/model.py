"""The quad table: its schema, its two notions of identity, and vocabulary IRIs.

Every operator takes and returns plain DataFrames.  A *quads* DataFrame has
the columns of ``QUADS``; ``g`` is NULL in the default graph and ``pos`` is
the load position, which decides every "first one wins" rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed vocabulary namespaces (public W3C / Dublin Core / OBO addresses).
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DC = "http://purl.org/dc/elements/1.1/"
DCTERMS = "http://purl.org/dc/terms/"
PROV = "http://www.w3.org/ns/prov#"
OBO = "http://purl.obolibrary.org/obo/"

PREFIXES = {
    "skos": SKOS, "dc": DC, "dcterms": DCTERMS,
    "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD,
}

TYPE = RDF + "type"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"
LABEL, COMMENT, SEE_ALSO = RDFS + "label", RDFS + "comment", RDFS + "seeAlso"
SUBCLASS, SUBPROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
DOMAIN, RANGE = RDFS + "domain", RDFS + "range"
THING, CLASS = OWL + "Thing", OWL + "Class"
EQUIVALENT, INTERSECTION = OWL + "equivalentClass", OWL + "intersectionOf"
PREF, ALT = SKOS + "prefLabel", SKOS + "altLabel"

QUADS = T.StructType([
    T.StructField("s", T.StringType()),
    T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()),
    T.StructField("o_kind", T.StringType()),
    T.StructField("o_datatype", T.StringType()),
    T.StructField("o_lang", T.StringType()),
    T.StructField("g", T.StringType()),
    T.StructField("pos", T.LongType()),
])
QUAD_COLS = QUADS.fieldNames()
STATEMENT = QUAD_COLS[:-1]

TERM = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("datatype", T.StringType()),
    T.StructField("lang", T.StringType()),
])

CLASS_KINDS = ["Class", "Defined", "Intersection"]
PROPERTY_KINDS = ["ObjectProperty", "DataProperty", "AnnotationProperty"]


def is_literal() -> Column:
    return F.col("o_kind") == "literal"


def is_resource() -> Column:
    return F.col("o_kind") != "literal"


def is_bnode(c: Column) -> Column:
    return c.startswith("_:")


def statement_key(cols: list[str] = STATEMENT) -> list[Column]:
    """Join/grouping key for *statement identity*: an absent datatype is not
    the same statement as an explicit ``xsd:string`` one."""
    return [F.coalesce(F.col(c), F.lit("")).alias(f"k_{c}") for c in cols]


def equality_key(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    """The looser *term equality*: language tags compare without case and a
    plain literal has datatype ``xsd:string``."""
    filled = F.when(lang.isNotNull(), F.lit(RDF + "langString")).otherwise(
        F.coalesce(datatype, F.lit(XSD + "string")))
    return F.struct(
        value.alias("value"),
        (kind == "literal").alias("literal"),
        F.when(kind == "literal", filled).alias("datatype"),
        F.lower(F.coalesce(lang, F.lit(""))).alias("lang"),
    )


def same_statement(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe join condition on statement identity (an equi-join: Spark
    hashes null-safe equalities)."""
    cond = F.lit(True)
    for c in STATEMENT:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def resource_quads(df: DataFrame, s: Column, p: Column, o: Column,
                   g: Column | None = None, pos: Column | None = None) -> DataFrame:
    """Shape three resource columns as quads."""
    return df.select(
        s.alias("s"), p.alias("p"), o.alias("o"),
        F.when(is_bnode(o), "bnode").otherwise("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"),
        F.lit(None).cast("string").alias("o_lang"),
        (g if g is not None else F.lit(None)).cast("string").alias("g"),
        (pos if pos is not None else F.lit(0)).cast("long").alias("pos"),
    )


def literal_quads(df: DataFrame, s: Column, p: Column, o: Column,
                  datatype: Column | None = None, lang: Column | None = None,
                  g: Column | None = None, pos: Column | None = None) -> DataFrame:
    """Shape subject, predicate and a literal value as quads."""
    null = F.lit(None)
    return df.select(
        s.alias("s"), p.alias("p"), o.cast("string").alias("o"),
        F.lit("literal").alias("o_kind"),
        (datatype if datatype is not None else null).cast("string").alias("o_datatype"),
        (lang if lang is not None else null).cast("string").alias("o_lang"),
        (g if g is not None else null).cast("string").alias("g"),
        (pos if pos is not None else F.lit(0)).cast("long").alias("pos"),
    )
