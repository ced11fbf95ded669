"""Set operations, query forms and updates, as pure DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.functions import terms as t
from quadrille.operators.paths import concise_description
from quadrille.session import cut


def union_(*parts: DataFrame) -> DataFrame:
    """UNION: bag semantics; a variable missing on one side is unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_(df: DataFrame) -> DataFrame:
    return df.distinct()


def reduced(df: DataFrame) -> DataFrame:
    """REDUCED may keep duplicates; we drop them all, as DISTINCT does."""
    return df.distinct()


def ask(df: DataFrame) -> DataFrame:
    """One row: does the pattern have any solution?  Stops at the first."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


TemplatePart = str | Column


def _part(df: DataFrame, x: TemplatePart, row: Column) -> Column:
    if isinstance(x, Column):
        return x
    if x.startswith("?"):
        return F.col(x[1:])
    if x.startswith("_:"):
        return t.resource(F.concat(F.lit("_:b"), F.substring(
            F.sha2(F.concat_ws("\u0001", row.cast("string"), F.lit(x)), 256), 1, 24)))
    return t.resource(F.lit(x))


def construct(df: DataFrame, template: list[tuple], solution_id: Column | None = None) -> DataFrame:
    """CONSTRUCT: a set of triples; rows that leave a part unbound or put a
    literal where none may stand are skipped.

    ``_:x`` in the template is a fresh blank node per solution, named from
    ``solution_id`` (numbered here when not given).
    """
    fresh = any(isinstance(x, str) and x.startswith("_:") for row in template for x in row)
    if solution_id is None and fresh:
        df = cut(df.withColumn("_row", F.monotonically_increasing_id()))
        solution_id = F.col("_row")
    row = solution_id if solution_id is not None else F.lit("")
    triples = F.explode(F.array(*[
        F.struct(*[_part(df, x, row).alias(n) for n, x in zip(("s", "p", "o", "g"), (*parts, None)[:4])
                   if x is not None], *([] if len(parts) > 3 else [F.lit(None).cast(m.TERM).alias("g")]))
        for parts in template]))
    out = df.select(triples.alias("x")).select("x.*")
    out = out.filter((F.col("s.kind") != "literal") & (F.col("p.kind") == "iri") & F.col("o").isNotNull())
    out = out.select(
        F.col("s.value").alias("s"), F.col("p.value").alias("p"), F.col("o.value").alias("o"),
        F.col("o.kind").alias("o_kind"), F.col("o.datatype").alias("o_datatype"),
        F.col("o.lang").alias("o_lang"), F.col("g.value").alias("g"))
    return out.distinct().withColumn("pos", F.lit(0).cast("long"))


def describe(quads: DataFrame, iris: DataFrame) -> DataFrame:
    """DESCRIBE: statements of the resources and of their blank nodes."""
    return concise_description(quads, iris).drop("root").distinct()


def result_iris(df: DataFrame) -> DataFrame:
    """Distinct IRIs in any column of a solution table."""
    one = F.explode(F.array(*[F.col(c) for c in df.columns])).alias("x")
    return df.select(one).filter("x.kind = 'iri'").select(F.col("x.value").alias("iri")).distinct()


# -- updates ----------------------------------------------------------------

def as_set(quads: DataFrame) -> DataFrame:
    """Set semantics on statement identity; the first position is kept."""
    return quads.groupBy(*m.STATEMENT).agg(F.min("pos").alias("pos")).select(*m.QUAD_COLS)


def subtract(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """Statements of ``quads`` that are not in ``gone``."""
    return quads.join(gone, m.same_statement(quads, gone), "left_anti")


def insert_data(quads: DataFrame, new: DataFrame) -> DataFrame:
    """``quads``, a set of statements, and those of ``new`` that it lacks.

    A statement that is there keeps its position.  What of ``new`` is there
    comes from a semi-join, for which a small ``new`` is broadcast by its
    measured size: the table is read, not shuffled or grouped.
    """
    own = [F.col(c).alias(f"_{c}") for c in m.STATEMENT]
    both = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in m.STATEMENT])
    fresh = as_set(new)
    there = quads.select(*m.STATEMENT).join(fresh.select(*own), both, "left_semi").select(*own)
    return quads.select(*m.QUAD_COLS).unionByName(fresh.join(there, both, "left_anti").select(*m.QUAD_COLS))


def delete_data(quads: DataFrame, gone: DataFrame) -> DataFrame:
    return subtract(quads, gone)


def delete_where(quads: DataFrame, template: list[tuple], where: DataFrame) -> DataFrame:
    return subtract(quads, construct(where, template))


def modify(quads: DataFrame, where: DataFrame, delete: list[tuple] | None = None,
           insert: list[tuple] | None = None, with_graph: str | None = None) -> DataFrame:
    """DELETE/INSERT ... WHERE: solutions are computed once, deletions come
    before insertions.  ``with_graph`` targets a named graph (WITH)."""
    solutions = cut(where)

    def made(template):
        rows = construct(solutions, template)
        return rows.withColumn("g", F.lit(with_graph)) if with_graph else rows

    out = quads
    if delete:
        out = subtract(out, made(delete))
    if insert:
        out = insert_data(out, made(insert))
    return out


def clear(quads: DataFrame, target: str) -> DataFrame:
    """CLEAR / DROP ``default``, ``named``, ``all`` or one graph IRI."""
    if target == "all":
        return quads.filter(F.lit(False))
    if target == "default":
        return quads.filter(F.col("g").isNotNull())
    if target == "named":
        return quads.filter(F.col("g").isNull())
    return quads.filter(~F.col("g").eqNullSafe(F.lit(target)))


def _in_graph(quads: DataFrame, g: str | None) -> DataFrame:
    return quads.filter(F.col("g").eqNullSafe(F.lit(g)))


def add_graph(quads: DataFrame, source: str | None, target: str | None) -> DataFrame:
    """ADD: the statements of ``source`` also go to ``target``; NULL is the
    default graph."""
    return insert_data(quads, _in_graph(quads, source).withColumn("g", F.lit(target).cast("string")))


def copy_graph(quads: DataFrame, source: str | None, target: str | None) -> DataFrame:
    if source == target:
        return quads
    kept = quads.filter(~F.col("g").eqNullSafe(F.lit(target)))
    return kept.unionByName(_in_graph(quads, source).withColumn("g", F.lit(target).cast("string")))


def move_graph(quads: DataFrame, source: str | None, target: str | None) -> DataFrame:
    if source == target:
        return quads
    return copy_graph(quads, source, target).filter(~F.col("g").eqNullSafe(F.lit(source)))
