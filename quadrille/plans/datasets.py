"""Quads derived from the relational tables, declared once as SQL expressions.

Each fact is a narrow ``SELECT`` with a literal predicate.  The union of facts
is a *virtual vertical partitioning*: a filter on ``p`` folds every other
branch away and the surviving scan reads only its own columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille import model as m

EX = "http://example.org/"


@dataclass(frozen=True)
class Fact:
    """One triple per row of a table; ``obj`` and ``subject`` are SQL text
    that Spark and ANSI engines read alike."""
    predicate: str
    obj: str
    kind: str = "iri"
    datatype: str | None = None
    lang: str | None = None
    where: str | None = None
    subject: str | None = None


@dataclass(frozen=True)
class TableMap:
    table: str
    subject: str
    key: str
    facts: tuple[Fact, ...]
    graph: str | None = None


def _text(v: str | None) -> str:
    return "cast(NULL AS string)" if v is None else f"'{v}'"


def _fact_sql(t: TableMap, f: Fact, i: int) -> list[str]:
    return [
        f"{f.subject or t.subject} AS s", f"'{f.predicate}' AS p",
        f"cast({f.obj} AS string) AS o", f"'{f.kind}' AS o_kind",
        f"{_text(f.datatype)} AS o_datatype", f"{_text(f.lang)} AS o_lang",
        f"{t.graph or 'cast(NULL AS string)'} AS g",
        f"cast({t.key} AS bigint) * 64 + {i} AS pos",
    ]


def _condition(f: Fact) -> str:
    return f"({f.obj}) IS NOT NULL" + (f" AND ({f.where})" if f.where else "")


def facts_to_quads(df: DataFrame, t: TableMap) -> DataFrame:
    """Direct mapping of one table's rows to quads."""
    parts = [df.where(_condition(f)).selectExpr(*_fact_sql(t, f, i))
             for i, f in enumerate(t.facts)]
    return reduce(DataFrame.unionAll, parts)


def _iri(kind: str, expr: str) -> str:
    return f"'{EX}{kind}/' || {expr}"


def _lit(predicate: str, expr: str, datatype: str | None = None, **kw) -> Fact:
    return Fact(predicate, expr, "literal", datatype and m.XSD + datatype, **kw)


def _const(iri: str) -> str:
    return f"'{iri}'"


_PART = _iri("part", "p_partkey")
_PARENT = _iri("part", "cast(floor(p_partkey / 6) AS bigint)")
_BRAND = _iri("brand", "substr(p_brand, 7)")
_KIND = _iri("type", "p_type")

DATASETS: dict[str, list[TableMap]] = {
    "geo": [
        TableMap("region", _iri("region", "r_regionkey"), "r_regionkey", (
            Fact(m.TYPE, _const(EX + "Region")),
            _lit(m.LABEL, "r_name"),
        )),
        TableMap("nation", _iri("nation", "n_nationkey"), "100 + n_nationkey", (
            Fact(m.TYPE, _const(EX + "Nation")),
            _lit(m.LABEL, "n_name"),
            _lit(m.LABEL, "lower(n_name)", lang="en"),
            Fact(EX + "inRegion", _iri("region", "n_regionkey")),
        )),
    ],
    "customers": [
        TableMap("customer", _iri("customer", "c_custkey"), "1000 + c_custkey", (
            Fact(m.TYPE, _const(EX + "Customer")),
            _lit(m.LABEL, "c_name"),
            Fact(EX + "fromNation", _iri("nation", "c_nationkey")),
            _lit(EX + "balance", "cast(c_acctbal AS decimal(18,2))", "decimal"),
            _lit(EX + "segment", "c_mktsegment"),
        )),
    ],
    "suppliers": [
        TableMap("supplier", _iri("supplier", "s_suppkey"), "5000000000 + s_suppkey", (
            Fact(m.TYPE, _const(EX + "Supplier")),
            _lit(m.LABEL, "s_name"),
            _lit(m.SEE_ALSO, "'nation ' || s_nationkey"),
            Fact(EX + "fromNation", _iri("nation", "s_nationkey")),
            _lit(EX + "balance", "cast(s_acctbal AS decimal(18,2))", "decimal",
                 where="s_acctbal > 5000"),
        )),
    ],
    "orders": [
        TableMap("orders", _iri("order", "o_orderkey"), "10000000000 + o_orderkey", (
            Fact(m.TYPE, _const(EX + "Order")),
            _lit(EX + "orderRef", "'ORD-' || o_orderkey"),
            Fact(EX + "orderedBy", _iri("customer", "o_custkey")),
            _lit(EX + "total", "cast(o_totalprice AS decimal(18,2))", "decimal"),
            _lit(EX + "orderDate", "cast(o_orderdate AS date)", "date"),
            _lit(EX + "status", "o_orderstatus"),
            _lit(EX + "priority", "o_orderpriority"),
        )),
    ],
    # customers again, each statement in the named graph of its nation
    "customer_graphs": [
        TableMap("customer", _iri("customer", "c_custkey"), "1000 + c_custkey", (
            Fact(m.TYPE, _const(EX + "Customer")),
            _lit(m.LABEL, "c_name"),
            _lit(EX + "balance", "cast(c_acctbal AS decimal(18,2))", "decimal"),
            _lit(EX + "segment", "c_mktsegment"),
        ), graph=_iri("graph", "c_nationkey")),
    ],
    # classes: part below its brand and below part (key div 6); brand below
    # type; type below Part.  p_size drives the irregular statements.
    "catalog": [
        TableMap("part", _PART, "p_partkey", (
            Fact(m.TYPE, _const(m.CLASS), where="p_size <> 47"),
            _lit(m.LABEL, "p_name", where="p_size NOT IN (48, 49, 50)"),
            _lit(m.LABEL, "' ' || p_name", where="p_size = 49"),
            _lit(m.LABEL, "''", where="p_size = 48"),
            _lit(m.LABEL, "'le ' || p_name", lang="fr", where="p_size > 40"),
            Fact(m.SUBCLASS, _BRAND),
            Fact(m.SUBCLASS, _PARENT, where="p_partkey > 0"),
            _lit(m.COMMENT, "'retail ' || cast(p_retailprice AS decimal(18,2))",
                 where="p_size BETWEEN 10 AND 20"),
            _lit(m.SEE_ALSO, "p_brand || ' ' || p_name", where="p_size < 5"),
            _lit(m.ALT, "p_brand || ' item'", where="p_size = 7"),
            _lit(m.SKOS + "definition", "p_type || ' ' || p_name",
                 where="p_size BETWEEN 15 AND 25"),
            _lit(m.OWL + "deprecated", "'true'", "boolean", where="p_size = 46"),
            _lit(m.OWL + "deprecated", "'yes'", where="p_size = 45"),
            _lit(m.PREF, "p_name", where="p_size = 7"),
            _lit(m.PREF, "p_brand", where="p_size = 7"),
            _lit(m.ALT, "p_name", where="p_size = 7"),
            _lit(EX + "size", "p_size", "integer"),
            _lit(EX + "retail", "cast(p_retailprice AS decimal(18,2))", "decimal"),
            Fact(m.SUBCLASS, _const(m.THING), where="p_size = 30"),
            Fact(m.SEE_ALSO, _iri("missing", "p_size"), where="p_size = 31"),
            Fact(m.TYPE, _const(m.CLASS), subject=_BRAND),
            _lit(m.LABEL, "p_brand", subject=_BRAND),
            Fact(m.SUBCLASS, _KIND, subject=_BRAND),
            Fact(m.TYPE, _const(m.CLASS), subject=_KIND),
            _lit(m.LABEL, "lower(p_type)", subject=_KIND),
            Fact(m.SUBCLASS, _const(EX + "Part"), subject=_KIND),
            Fact(m.TYPE, _const(m.OWL + "ObjectProperty"), subject=_iri("prop", "p_type")),
            Fact(m.TYPE, _const(m.OWL + "FunctionalProperty"), subject=_iri("prop", "p_type")),
            Fact(m.DOMAIN, _KIND, subject=_iri("prop", "p_type"), where="p_size = 1"),
            Fact(m.RANGE, _BRAND, subject=_iri("prop", "p_type"), where="p_size < 3"),
            Fact(m.TYPE, _const(m.OWL + "DatatypeProperty"), subject=f"'{EX}size'"),
            Fact(m.SUBPROPERTY, _const(EX + "related"), subject=_iri("prop", "p_type")),
        )),
    ],
    # anonymous class expressions hanging off the part classes
    "definitions": [
        TableMap("part", _PART, "4000000000 + p_partkey", (
            Fact(m.SUBCLASS, "'_:r' || p_partkey", "bnode", where="p_size % 10 < 2"),
            Fact(m.OWL + "onProperty", _const(EX + "madeBy"), subject="'_:r' || p_partkey",
                 where="p_size % 10 < 2"),
            Fact(m.OWL + "someValuesFrom", _BRAND, subject="'_:r' || p_partkey",
                 where="p_size % 10 = 0"),
            _lit(m.OWL + "minCardinality", "p_size", "nonNegativeInteger",
                 subject="'_:r' || p_partkey", where="p_size % 10 = 1"),
            Fact(m.EQUIVALENT, "'_:i' || p_partkey", "bnode", where="p_size % 10 = 2"),
            Fact(m.SUBCLASS, "'_:i' || p_partkey", "bnode", where="p_size % 10 = 3"),
            Fact(m.INTERSECTION, "'_:l' || p_partkey || 'a'", "bnode",
                 subject="'_:i' || p_partkey", where="p_size % 10 IN (2, 3)"),
            Fact(m.FIRST, _BRAND, subject="'_:l' || p_partkey || 'a'",
                 where="p_size % 10 IN (2, 3, 4)"),
            Fact(m.REST, "'_:l' || p_partkey || 'b'", "bnode",
                 subject="'_:l' || p_partkey || 'a'", where="p_size % 10 IN (2, 3, 4)"),
            Fact(m.FIRST, _PARENT, subject="'_:l' || p_partkey || 'b'",
                 where="p_size % 10 IN (2, 3, 4)"),
            Fact(m.REST, _const(m.NIL), subject="'_:l' || p_partkey || 'b'",
                 where="p_size % 10 IN (2, 3, 4)"),
        )),
    ],
    # small directed rings: key stays inside its block of seven
    "rings": [
        TableMap("part", _PART, "p_partkey", (
            Fact(m.SUBCLASS, _iri("part", "(p_partkey - p_partkey % 7 + (p_partkey + p_size) % 7)"),
                 where="p_size % 3 > 0"),
            Fact(m.TYPE, _const(m.CLASS)),
            _lit(m.LABEL, "p_name"),
        )),
    ],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# facts whose subject is shared by many rows repeat: keep the first statement
_REPEATING = {"catalog"}


def quads(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The quads of one or more datasets, with set semantics."""
    parts = []
    for name in names:
        for t in DATASETS[name]:
            part = facts_to_quads(table(spark, sf_dir, t.table), t)
            if name in _REPEATING:
                part = part.groupBy(*m.STATEMENT).agg(F.min("pos").alias("pos"))
            parts.append(part)
    return reduce(DataFrame.unionAll, parts)


def expected_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """At most so many quads; rows are counted in the footers of the files."""
    return sum(table(spark, sf_dir, t.table).count() * len(t.facts) for t in DATASETS[name])


def quads_sql(*names: str) -> str:
    """The same quads as ANSI SQL text over the registered tables."""
    parts = []
    for name in names:
        for t in DATASETS[name]:
            rows = " UNION ALL ".join(
                f"SELECT {', '.join(_fact_sql(t, f, i))} FROM {t.table} WHERE {_condition(f)}"
                for i, f in enumerate(t.facts))
            if name in _REPEATING:
                cols = ", ".join(m.STATEMENT)
                rows = f"SELECT {cols}, min(pos) AS pos FROM ({rows}) GROUP BY {cols}"
            parts.append(rows)
    return " UNION ALL ".join(f"({p})" for p in parts)
