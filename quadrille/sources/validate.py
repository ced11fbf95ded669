"""Statement validation at ingest: syntax, lengths, language and datatype."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m

# Lengths and the short datatype names accepted beside IRIs.
MAX_IRI, MAX_LITERAL = 10_000, 1_000_000
SHORT_TYPES = ["string", "decimal", "integer", "dateTime", "boolean", "double"]
_IRI = r'(?i)^[a-z][a-z0-9+.-]*:[^\s<>"{}|^\x00-\x1f]*$'
_BNODE = r"^_:[A-Za-z0-9_]\S*$"


def is_resource(c: Column, blank: bool = True) -> Column:
    ok = c.rlike(_IRI) & ~c.startswith("_:")
    return (F.length(c) > 0) & (F.length(c) <= MAX_IRI) & ((ok | c.rlike(_BNODE)) if blank else ok)


def reason() -> Column:
    """Why a quads row is invalid; NULL when it is fine."""
    lit = F.col("o_kind") == "literal"
    lang, kind = F.col("o_lang"), F.col("o_datatype")
    return (F.when(~F.coalesce(is_resource(F.col("s")), F.lit(False)), "subject")
            .when(~F.coalesce(is_resource(F.col("p"), False), F.lit(False)), "predicate")
            .when(F.col("o").isNull() | F.col("o_kind").isNull(), "object")
            .when(F.length("o") > MAX_LITERAL, "object length")
            .when(~lit & ~is_resource(F.col("o")), "object")
            .when(F.col("g").isNotNull() & ~is_resource(F.col("g")), "graph")
            .when(lang.isNotNull() & ~lang.rlike(r"^[a-zA-Z]+(-[a-zA-Z0-9]+)*$"), "language")
            .when(kind.isNotNull() & ~is_resource(kind, False) & ~kind.isin(SHORT_TYPES), "datatype")
            .when(~lit & (lang.isNotNull() | kind.isNotNull()), "resource with datatype")
            .when(lang.isNotNull() & kind.isNotNull() & (kind != m.RDF + "langString"), "language and datatype"))


def split_valid(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid quads, refused rows with ``reason``)."""
    judged = quads.withColumn("reason", reason())
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")
