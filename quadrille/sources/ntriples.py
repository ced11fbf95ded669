"""N-Triples and N-Quads as splittable text: read, quarantine, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille import model as m
from quadrille.operators.updates import as_set

_RES = r"(?:<[^<>\"{}|^`\x00-\x20]*>|_:[A-Za-z0-9_][^\s<>\"]*)"
_BAD_ESCAPE = r"\\(?!u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"
# A lazy run up to a quote without an odd number of backslashes before it: unlike
# a repeated group it costs Java's matcher no stack on long literals, and the
# backslashes are counted only at quotes.
_LIT = (r'"[^\n\r]*?"(?<!(?<!\\)\\(?:\\\\){0,50}")'
        r"(?:\^\^<[^<>\s]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?")
_TAIL = rf"\s*({_RES})?\s*\.\s*(?:#.*)?$"


def _bare(c: Column) -> Column:
    inside = F.regexp_extract(c, "^<(.*)>$", 1)
    return F.when(c.startswith("<"), _unescape(inside)).otherwise(c)


def _unescape(c: Column) -> Column:
    """String escapes, including ``\\uXXXX`` and ``\\UXXXXXXXX``, by way of
    the JSON reader, which knows all but the last and ``\\'``."""
    wide = F.regexp_extract_all(c, F.lit(r"(?<!\\)\\U([0-9A-Fa-f]{8})"), 1)

    def as_json(code: Column) -> Column:
        n = F.conv(code, 16, 10).cast("int")
        pair = F.concat(F.lit("\\u"), F.lower(F.hex(F.lit(55296) + F.floor((n - 65536) / 1024))),
                        F.lit("\\u"), F.lower(F.hex(F.lit(56320) + (n - 65536) % 1024)))
        return F.when(n > 65535, pair).otherwise(F.concat(F.lit("\\u"), F.substring(code, 5, 4)))

    text = F.aggregate(wide, c, lambda acc, code: F.replace(acc, F.concat(F.lit("\\U"), code), as_json(code)))
    text = F.regexp_replace(F.regexp_replace(text, r"\\'", "'"), "\t", r"\\t")
    parsed = F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v")
    return F.when(c.contains("\\"), parsed).otherwise(c)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quads, quarantine) from ``lines(value)``; blank lines and comments
    are skipped, quoted triples and broken lines are quarantined."""
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    # term by term from the left, each pattern anchored at the start of what is left
    x = rows.select("*", F.trim("value").alias("_v"))
    x = x.withColumn("_s", F.regexp_extract("_v", rf"^{_RES}\s*", 0))
    x = x.withColumn("_v1", F.substr(F.col("_v"), F.length("_s") + 1))
    x = x.withColumn("_p", F.regexp_extract("_v1", r"^<[^<>\s]*>\s*", 0))
    x = x.withColumn("_v2", F.substr(F.col("_v1"), F.length("_p") + 1))
    x = x.withColumn("t", F.regexp_extract("_v2", rf"^(?:{_LIT}|{_RES})(?={_TAIL})", 0))
    x = x.withColumn("_v3", F.substr(F.col("_v2"), F.length("t") + 1))
    inside = F.regexp_extract("t", r'^"(.*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1)
    stray = F.col("t").startswith('"') & F.regexp_replace(inside, r"\\.", "").rlike(r'["\\]')
    x = x.withColumn("_ok", (F.col("_s") != "") & (F.col("_p") != "") & (F.col("t") != "") & ~stray
                     & ~F.concat("_s", "_p", F.when(F.col("t").startswith('"'), "").otherwise(F.col("t")),
                                 F.regexp_extract("_v3", "^" + _TAIL, 1)).rlike(_BAD_ESCAPE))
    bad = x.filter("not _ok").select(F.col("value").alias("line"))
    t = x.filter("_ok").select(F.trim("_s").alias("s"), F.trim("_p").alias("p"), "t",
                               F.regexp_extract("_v3", "^" + _TAIL, 1).alias("g"), *rest)
    literal = F.col("t").startswith('"')
    lex = F.regexp_extract("t", r'^"(.*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1)
    kind = F.regexp_extract("t", r'"\^\^<([^>]*)>$', 1)
    lang = F.regexp_extract("t", r'"@([A-Za-z0-9-]+)$', 1)
    quads = t.select(
        _bare(F.col("s")).alias("s"), _bare(F.col("p")).alias("p"),
        F.when(literal, _unescape(lex)).otherwise(_bare(F.col("t"))).alias("o"),
        F.when(literal, "literal").when(F.col("t").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.when(literal & (kind != ""), kind).alias("o_datatype"),
        F.when(literal & (lang != ""), lang).alias("o_lang"),
        F.when(F.col("g") != "", _bare(F.col("g"))).alias("g"),
        F.monotonically_increasing_id().alias("pos"), *rest)
    return quads, bad


def read_nquads(spark: SparkSession, path: str, scoped: bool = True) -> tuple[DataFrame, DataFrame]:
    """(quads, quarantine) of N-Quads files; a text scan, so large files split.

    ``scoped`` keeps blank nodes of different files apart.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    quads, bad = parse_lines(lines)
    return (scope_bnodes(quads, "_file") if scoped else quads.drop("_file")), bad


def read_ntriples(spark: SparkSession, path: str, scoped: bool = True) -> tuple[DataFrame, DataFrame]:
    """As ``read_nquads``; a fourth term is not allowed and is quarantined."""
    quads, bad = read_nquads(spark, path, scoped)
    extra = quads.filter("g is not null").select(F.concat_ws(" ", "s", "p", "o", "g").alias("line"))
    return quads.filter("g is null"), bad.unionByName(extra)


def scope_bnodes(quads: DataFrame, file_col: str) -> DataFrame:
    """Prefix blank node labels with a digest of their file."""
    prefix = F.concat(F.lit("_:f"), F.substring(F.sha2(F.col(file_col), 256), 1, 16), F.lit("_"))

    def scoped(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.concat(prefix, F.substr(F.col(c), F.lit(3)))).otherwise(F.col(c))

    obj = F.when(F.col("o_kind") == "bnode", scoped("o")).otherwise(F.col("o"))
    return quads.select(scoped("s").alias("s"), "p", obj.alias("o"), "o_kind", "o_datatype", "o_lang", scoped("g").alias("g"), "pos")


def dedupe(quads: DataFrame) -> DataFrame:
    """Each statement once, at its first position."""
    return as_set(quads)


def escape_literal(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def full_datatype(c: Column) -> Column:
    return F.when(c.contains(":"), c).otherwise(F.concat(F.lit(m.XSD), c))


def line_of(with_graph: bool = True) -> Column:
    """A quads row as one N-Quads line."""
    def res(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    tail = (F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang"))
            .when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), full_datatype(F.col("o_datatype")), F.lit(">"))).otherwise(""))
    obj = F.when(m.is_literal(), F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'), tail)).otherwise(res("o"))
    return F.concat_ws(" ", res("s"), res("p"), obj, *([res("g")] if with_graph else []), F.lit("."))


def write_nquads(quads: DataFrame, path: str) -> None:
    quads.select(line_of().alias("value")).write.mode("overwrite").text(path)


def write_ntriples(quads: DataFrame, path: str) -> None:
    """Triples only; a dataset with named graphs is refused, not flattened."""
    if not quads.filter("g is not null").isEmpty():
        raise ValueError("the dataset has named graphs: write N-Quads to keep them")
    quads.select(line_of(False).alias("value")).write.mode("overwrite").text(path)
