"""Batch edits: functions from quads to quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.functions import text as tx
from quadrille.operators import taxonomy as tax
from quadrille.operators.aggregates import mint_iris, preferred_label
from quadrille.operators.entities import DECLARED_KIND, drop_orphan_lists, drop_redundant_thing, intersections
from quadrille.operators.paths import reach
from quadrille.operators.patterns import validate_cells
from quadrille.operators.updates import as_set, insert_data, subtract
from quadrille.session import cut
from quadrille.sources.validate import split_valid


def _subclass(df: DataFrame, child: str, parent: str) -> DataFrame:
    return m.resource_quads(df, F.col(child), F.lit(m.SUBCLASS), F.col(parent))


def rename_iris(quads: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace IRIs ``mapping(old, new)`` in all four positions.

    One join per position; AQE broadcasts the mapping when it is small.
    """
    out = quads
    for col in ("s", "p", "g", "o"):
        side = mapping.select(F.col("old").alias(col), F.col("new").alias("_new"))
        moved = F.coalesce("_new", F.col(col))
        if col == "o":
            moved = F.when(m.is_resource(), moved).otherwise(F.col(col))
        out = out.join(side, col, "left").withColumn(col, moved).drop("_new")
    return as_set(out.select(*m.QUAD_COLS))


def replace_subjects(quads: DataFrame, statements: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """All statements of the subjects in ``statements`` are replaced by them;
    ``mapping(old, new)`` renames afterwards."""
    owners = statements.select("s").distinct()
    out = insert_data(quads.join(owners, "s", "left_anti").select(*m.QUAD_COLS), statements)
    return rename_iris(out, mapping) if mapping is not None else out


def move_classes(quads: DataFrame, parents: DataFrame, classes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move ``moves(iri, from_parent, parent)``, keeping other parents.

    Returns the quads and the refused moves; a class below another moved one
    travels with it.
    """
    checked = cut(tax.check_moves(parents, classes, moves.select("iri", "parent")).join(moves, ["iri", "parent"]))
    refused = checked.filter("issue is not null").select("iri", "parent", "issue")
    fine = checked.filter("issue is null")
    tops = tax.branch_roots(parents, fine.select("iri"))
    fine = cut(fine.join(tops, "iri", "left_semi"))
    gone = fine.filter("from_parent is not null").select(F.col("iri").alias("s"), F.lit(m.SUBCLASS).alias("p"), F.col("from_parent").alias("o"))
    out = quads.join(gone, ["s", "p", "o"], "left_anti").select(*m.QUAD_COLS)
    return drop_redundant_thing(insert_data(out, _subclass(fine, "iri", "parent"))), refused


def delete_classes(quads: DataFrame, iris: DataFrame) -> DataFrame:
    """Delete classes and every reference to them; their children go to the
    nearest surviving ancestors, or to owl:Thing."""
    gone = cut(iris.select("iri").filter(F.col("iri") != m.THING).distinct())
    edges = cut(quads.filter((F.col("p") == m.SUBCLASS) & (F.col("o_kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct())
    dead_src = edges.join(gone.select(F.col("iri").alias("src")), "src", "left_semi")
    # climb only through deleted classes
    climb = reach(dead_src).select(F.col("start").alias("dst"), F.col("node").alias("up"))
    orphans = edges.join(gone.select(F.col("iri").alias("dst")), "dst", "left_semi").join(
        gone.select(F.col("iri").alias("src")), "src", "left_anti")
    alive = climb.join(gone.select(F.col("iri").alias("up")), "up", "left_anti")
    moved = orphans.join(alive, "dst", "left").filter("up is null or up <> src").select("src", F.coalesce("up", F.lit(m.THING)).alias("up"))
    dead = gone.select(F.col("iri").alias("s"))
    out = quads.join(dead, "s", "left_anti").join(
        gone.select(F.col("iri").alias("o"), F.lit(True).alias("_dead")), "o", "left").filter(
        F.col("_dead").isNull() | m.is_literal()).select(*m.QUAD_COLS)
    return drop_redundant_thing(insert_data(out, _subclass(moved.distinct(), "src", "up")))


def create_entities(quads: DataFrame, rows: DataFrame, namespace: str) -> DataFrame:
    """New entities from ``rows(id, label, kind, type, comment)``: minted IRI,
    declaration, label, optional type and comment, ampersand synonym."""
    known = quads.select(F.explode(F.when(m.is_resource(), F.array("s", "p", "o")).otherwise(F.array("s", "p"))).alias("iri")).distinct()
    clean = F.trim(F.regexp_replace(F.col("label"), r"\s+", " "))
    made = cut(rows.withColumn("label", clean).join(mint_iris(rows.select("id", "label"), known, namespace), "id"))
    types = {v: k for k, v in reversed(DECLARED_KIND.items())} | {
        "Class": m.CLASS, "ObjectProperty": m.OWL + "ObjectProperty", "Individual": m.OWL + "NamedIndividual"}
    declared = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.col("kind")]
    s, xs = F.col("iri"), F.lit(m.XSD + "string")
    parts = [
        m.resource_quads(made, s, F.lit(m.TYPE), declared),
        m.literal_quads(made, s, F.lit(m.LABEL), F.col("label"), xs),
        m.resource_quads(made.filter("type is not null"), s, F.lit(m.TYPE), F.col("type")),
        m.literal_quads(made.filter("coalesce(comment, '') <> ''"), s, F.lit(m.COMMENT), F.col("comment"), xs),
        m.literal_quads(made.withColumn("_syn", tx.ampersand_synonym(F.col("label"))).filter("_syn is not null"),
                        s, F.lit(m.SEE_ALSO), F.col("_syn"), xs),
    ]
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p)
    return insert_data(quads, new)


def create_classes(quads: DataFrame, rows: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """A hierarchy from ``rows(id, label, parent_id, parent_iri)``; parents by
    row id or IRI, owl:Thing when none.

    Returns the quads and the rows refused because they form a cycle.
    """
    links = rows.filter("parent_id is not null").select(F.col("id").cast("string").alias("src"), F.col("parent_id").cast("string").alias("dst"))
    bad = cut(tax.cyclic_nodes(links).select(F.col("iri").cast("long").alias("id")))
    good = rows.join(bad, "id", "left_anti")
    known = quads.select(F.explode(F.when(m.is_resource(), F.array("s", "p", "o")).otherwise(F.array("s", "p"))).alias("iri")).distinct()
    made = cut(mint_iris(good.select("id", "label"), known, namespace))
    rows_iri = good.join(made, "id").join(made.select(F.col("id").alias("parent_id"), F.col("iri").alias("_up")), "parent_id", "left")
    rows_iri = cut(rows_iri.withColumn("up", F.coalesce("_up", "parent_iri", F.lit(m.THING))))
    new = (m.resource_quads(rows_iri, F.col("iri"), F.lit(m.TYPE), F.lit(m.CLASS))
           .unionByName(m.literal_quads(rows_iri, F.col("iri"), F.lit(m.LABEL), F.trim("label"), F.lit(m.XSD + "string")))
           .unionByName(_subclass(rows_iri, "iri", "up")))
    return insert_data(quads, new), rows.join(bad, "id", "left_semi")


def insert_above(quads: DataFrame, rows: DataFrame) -> DataFrame:
    """Put class ``iri`` between ``child`` and its parents: the child keeps
    only the new parent, which takes over the old ones."""
    old = quads.filter((F.col("p") == m.SUBCLASS) & (F.col("o_kind") == "iri")).join(
        rows.select(F.col("child").alias("s"), "iri"), "s")
    up = _subclass(old.filter("iri <> o").select(F.col("iri").alias("a"), F.col("o").alias("b")), "a", "b")
    out = subtract(quads, old.select(*m.QUAD_COLS))
    return insert_data(insert_data(out, up), _subclass(rows, "child", "iri"))


def edit_edges(quads: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits(id, op, s, p, o, new_o)`` with op add, edit or remove.

    Returns the quads and the refused edits: an endpoint or the edge is
    missing, or the edge exists already.
    """
    nodes = quads.select(F.explode(F.when(m.is_resource(), F.array("s", "o")).otherwise(F.array("s"))).alias("n")).distinct()
    have = quads.filter(m.is_resource()).select("s", "p", "o").distinct()
    target = F.when(F.col("op") == "edit", F.col("new_o")).when(F.col("op") == "add", F.col("o"))
    rows = edits.withColumn("t", target)
    rows = (rows.join(have.withColumn("_old", F.lit(True)), ["s", "p", "o"], "left")
            .join(have.select("s", "p", F.col("o").alias("t"), F.lit(True).alias("_new")), ["s", "p", "t"], "left")
            .join(nodes.select(F.col("n").alias("s"), F.lit(True).alias("_s")), "s", "left")
            .join(nodes.select(F.col("n").alias("t"), F.lit(True).alias("_t")), "t", "left"))
    reason = (F.when((F.col("op") != "add") & F.col("_old").isNull(), "no such edge")
              .when((F.col("op") != "remove") & (F.col("_s").isNull() | F.col("_t").isNull()), "missing node")
              .when((F.col("op") != "remove") & F.col("_new"), "exists"))
    rows = cut(rows.withColumn("refused", reason).select("id", "op", "s", "p", "o", "t", "refused"))
    fine = rows.filter("refused is null")
    gone = fine.filter("op <> 'add'").select("s", "p", "o")
    out = quads.join(gone.withColumn("_gone", F.lit(True)), ["s", "p", "o"], "left").filter(
        F.col("_gone").isNull() | m.is_literal()).select(*m.QUAD_COLS)
    new = m.resource_quads(fine.filter("op <> 'remove'"), F.col("s"), F.col("p"), F.col("t"))
    return insert_data(out, new), rows.filter("refused is not null").select("id", "op", "refused")


def set_intersection(quads: DataFrame, rows: DataFrame, relation: str = m.EQUIVALENT) -> DataFrame:
    """Define classes as conjunctions: ``rows(iri, position, member)``, one
    row per member in order; builds the RDF list cells.

    The cell names derive from class and position, so members of one class
    need no gathering.
    """
    base = F.concat(F.lit("_:d"), F.substring(F.sha2("iri", 256), 1, 24))
    last = rows.groupBy("iri").agg(F.max("position").alias("_last"))
    x = rows.join(last, "iri").withColumn("cell", F.concat(base, F.lit("_"), F.col("position").cast("string")))
    nxt = F.when(F.col("position") == F.col("_last"), m.NIL).otherwise(
        F.concat(base, F.lit("_"), (F.col("position") + 1).cast("string")))
    heads = rows.groupBy("iri").agg(F.min("position").alias("_first"))
    heads = heads.withColumn("expr", base).withColumn("head", F.concat(base, F.lit("_"), F.col("_first").cast("string")))
    old = quads.join(heads.select(F.col("iri").alias("s"), F.lit(relation).alias("p")), ["s", "p"], "left_semi").filter(m.is_bnode(F.col("o")))
    new = (m.resource_quads(x, F.col("cell"), F.lit(m.FIRST), F.col("member"))
           .unionByName(m.resource_quads(x, F.col("cell"), F.lit(m.REST), nxt))
           .unionByName(m.resource_quads(heads, F.col("expr"), F.lit(m.INTERSECTION), F.col("head")))
           .unionByName(m.resource_quads(heads, F.col("iri"), F.lit(relation), F.col("expr"))))
    rest = cut(subtract(quads, old.select(*m.QUAD_COLS)))
    # the cells of the replaced lists go, unless something else refers to them
    rest = drop_orphan_lists(rest, intersections(rest), old.select(F.col("o").alias("expr")).distinct())
    return insert_data(rest, new)


def add_parents(quads: DataFrame, parents: DataFrame, classes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``rows(iri, parent)``; returns the quads and refused rows."""
    checked = cut(tax.check_moves(parents, classes, rows))
    fine = checked.filter("issue is null")
    out = drop_redundant_thing(insert_data(quads, _subclass(fine, "iri", "parent")))
    return out, checked.filter("issue is not null")


def add_literals(quads: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``rows(iri, predicate, value, lang)`` unless the same literal is
    there; a plain literal and xsd:string count as the same."""
    kind = F.when(F.col("lang").isNull(), m.XSD + "string")
    new = m.literal_quads(rows, F.col("iri"), F.col("predicate"), F.col("value"), kind, F.col("lang")).distinct()
    have = quads.filter(m.is_literal()).select("s", "p", "o", F.lower(F.coalesce("o_lang", F.lit(""))).alias("_l"),
                                               F.coalesce("o_datatype", F.when(F.col("o_lang").isNull(), m.XSD + "string")).alias("_d")).distinct()
    keyed = new.withColumn("_l", F.lower(F.coalesce("o_lang", F.lit("")))).withColumn("_d", F.col("o_datatype"))
    cond = [keyed[c].eqNullSafe(have[c]) for c in ("s", "p", "o", "_l", "_d")]
    return quads.unionByName(keyed.join(have, cond, "left_anti").select(*m.QUAD_COLS))


def rename_labels(quads: DataFrame, rows: DataFrame) -> DataFrame:
    """Change the preferred label of ``rows(iri, label)``; its language and
    graph stay, other labels are untouched."""
    best = preferred_label(quads).join(rows.select("iri", F.trim("label").alias("_new")), "iri")
    target = best.select(F.col("iri").alias("s"), F.lit(m.LABEL).alias("p"), F.col("label").alias("o"), F.col("lang").alias("_lang"), "_new")
    joined = quads.join(target, ["s", "p", "o"], "left")
    hit = F.col("_new").isNotNull() & m.is_literal() & F.col("o_lang").eqNullSafe(F.col("_lang"))
    return as_set(joined.withColumn("o", F.when(hit, F.col("_new")).otherwise(F.col("o"))).select(*m.QUAD_COLS))


def edit_cells(df: DataFrame, edits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Apply ``edits(key, price, rating)`` to fact rows after validation;
    returns the rows and the refused edits with their reasons."""
    checked = cut(validate_cells(edits))
    ok = checked.filter("price_reason is null and rating_reason is null").select(key, "price_value", "rating_value")
    out = df.join(ok, key, "left")
    out = out.withColumn("price", F.coalesce("price_value", "price")).withColumn("rating", F.coalesce("rating_value", "rating"))
    return out.select(*df.columns), checked.filter("price_reason is not null or rating_reason is not null").select(
        key, "price_reason", "rating_reason")


def replace_quads(new: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Replace a stored dataset, partitioned by predicate, when every new
    statement is valid; returns (written, refused)."""
    good, bad = split_valid(new)
    refused = cut(bad)
    if not refused.isEmpty():
        return good.limit(0), refused
    # rebalancing splits a hot predicate and packs rare ones into few files
    as_set(good).hint("rebalance", "p").write.mode("overwrite").partitionBy("p").parquet(path)
    return new.sparkSession.read.parquet(path).select(*m.QUAD_COLS), refused


FIXED_PREDICATES = [m.TYPE, m.LABEL, m.SUBCLASS, m.COMMENT, m.SUBPROPERTY]
RESOURCE_VALUED = [m.EQUIVALENT, m.RDFS + "isDefinedBy", m.DOMAIN, m.RANGE, m.OWL + "disjointWith", m.OWL + "inverseOf"]


def check_creations(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Errors per creation row ``(id, iri, kind, target, predicate, value)``:
    the relation target and the extra statement must fit."""
    target = kinds.select(F.col("iri").alias("target"), F.col("kind").alias("_tk"))
    props = kinds.select(F.col("iri").alias("predicate"), F.col("kind").alias("_pk"))
    x = rows.join(target, "target", "left").join(props, "predicate", "left")
    fits = F.when(F.col("kind").isin("Class", "Individual"), F.col("_tk").isin("Class", "Defined")).otherwise(F.col("_tk") == F.col("kind"))
    resource = F.col("predicate").isin(RESOURCE_VALUED) | F.coalesce(F.col("_pk") == "ObjectProperty", F.lit(False))
    is_iri = F.col("value").rlike(r'^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>"{}|^]*$')
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    errors = F.array_compact(F.array(
        F.when(F.col("target") == F.col("iri"), "own target"),
        F.when((F.col("target") != F.col("iri")) & ~F.coalesce(fits, F.lit(False)), "target kind"),
        F.when(F.col("predicate").isin(FIXED_PREDICATES), "predicate"),
        F.when(F.length("value") > 10000, "value length"),
        F.when(filled & resource & ~is_iri, "value must be an IRI")))
    return x.select("id", errors.alias("errors"))
