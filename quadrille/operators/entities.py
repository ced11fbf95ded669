"""Entity projection: kinds, labels, characteristics and OWL class expressions.

Multi-valued facets (parents, types, restrictions, list members) stay long
tables, one row per value, so that no entity is gathered into a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.functions import text as tx
from quadrille.operators.aggregates import preferred_label
from quadrille.operators.paths import reach
from quadrille.session import cut

# The kind each declaration gives its subject.
DECLARED_KIND = {
    m.OWL + "Class": "Class", m.RDFS + "Class": "Class",
    m.OWL + "ObjectProperty": "ObjectProperty", m.RDF + "Property": "ObjectProperty",
    m.OWL + "DatatypeProperty": "DataProperty", m.OWL + "AnnotationProperty": "AnnotationProperty",
    m.RDFS + "Datatype": "Datatype", m.OWL + "NamedIndividual": "Individual",
}
QUANTIFIERS = {"someValuesFrom": "some", "allValuesFrom": "only", "hasValue": "value",
               "minCardinality": "min", "maxCardinality": "max", "cardinality": "exactly"}


def _lookup(d: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[key]


def declared_types() -> list[str]:
    return [t for t in DECLARED_KIND if t != m.RDFS + "Datatype"]


# -- kinds ------------------------------------------------------------------

def base_kinds(quads: DataFrame) -> DataFrame:
    """(iri, kind) from declarations and usage, before class expressions.

    Declarations, type objects and subclass ends decide by the *last*
    position; weak hints (an unknown type, a subproperty end) by the first;
    everything else mentioned is a Resource.  One pass, all partial
    aggregates.
    """
    s, o, res = F.col("s"), F.col("o"), m.is_resource()
    declared = _lookup(DECLARED_KIND, o)
    own = ~(o.startswith(m.OWL) | o.startswith(m.RDF) | o.startswith(m.RDFS))
    is_type, is_sub, is_subprop = (F.col("p") == p for p in (m.TYPE, m.SUBCLASS, m.SUBPROPERTY))

    def event(iri: Column, kind, strong: bool, when: Column) -> Column:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        return F.when(when, F.struct(iri.alias("iri"), kind.alias("kind"), F.lit(strong).alias("strong")))

    no = F.lit(None).cast("string")
    events = F.explode(F.array_compact(F.array(
        event(s, declared, True, is_type & res & declared.isNotNull()),
        event(s, "Resource", False, is_type & res & declared.isNull()),
        event(o, "Class", True, is_type & res & declared.isNull() & own),
        event(s, "Class", True, is_sub),
        event(o, "Class", True, is_sub & res & ~m.is_bnode(o)),
        event(s, "ObjectProperty", False, is_subprop),
        event(o, "ObjectProperty", False, is_subprop & res),
        event(s, no, False, ~(is_type & res) & ~is_sub & ~is_subprop),
        event(o, no, False, res & ~((is_type & own & declared.isNull()) | is_sub | is_subprop)),
    )))
    rows = quads.select("pos", events.alias("e")).select("pos", "e.*")
    strong = F.max_by(F.when(F.col("strong"), F.col("kind")), F.when(F.col("strong"), F.col("pos")))
    weak_pos = F.when(~F.col("strong") & F.col("kind").isNotNull(), F.col("pos"))
    weak = F.min_by(F.when(~F.col("strong"), F.col("kind")), weak_pos)
    kinds = rows.groupBy("iri").agg(F.coalesce(strong, weak, F.lit("Resource")).alias("kind"))
    return kinds.withColumn("kind", F.when(F.col("iri") == m.THING, "Class").otherwise(F.col("kind")))


def entity_types(quads: DataFrame) -> DataFrame:
    """(iri, type) without the declarations."""
    return quads.filter((F.col("p") == m.TYPE) & m.is_resource() & ~F.col("o").isin(declared_types())).select(
        F.col("s").alias("iri"), F.col("o").alias("type")).distinct()


def project_kinds(quads: DataFrame, intersections: DataFrame | None = None) -> DataFrame:
    """Final (iri, kind): typed resources become Individuals, classes with an
    equivalent Defined, and conjunctions are reflected in both."""
    kinds = cut(base_kinds(quads))
    classes = kinds.filter(F.col("kind") == "Class").select(F.col("iri").alias("type"))
    typed = entity_types(quads).join(classes, "type", "left_semi").select("iri", F.lit(True).alias("_typed")).distinct()
    equal = restrictions(quads).filter(F.col("relation") == m.EQUIVALENT).select("iri").unionAll(
        quads.filter((F.col("p") == m.EQUIVALENT) & (F.col("o_kind") == "iri")).select("s")).distinct()
    out = (kinds.join(typed, "iri", "left").join(equal.withColumn("_eq", F.lit(True)), "iri", "left"))
    kind = (F.when((F.col("kind") == "Resource") & F.col("_typed"), "Individual")
            .when((F.col("kind") == "Class") & F.col("_eq"), "Defined").otherwise(F.col("kind")))
    out = out.select("iri", kind.alias("kind"))
    if intersections is None:
        return cut(out)
    heads = intersections.select(F.col("expr").alias("iri"), F.lit(True).alias("_head")).distinct()
    members = intersections.filter("issue is null").select(F.col("member").alias("iri"), F.lit(True).alias("_member")).distinct()
    owners = expression_references(quads, intersections).groupBy(F.col("owner").alias("iri")).agg(
        F.max(F.col("relation") == m.EQUIVALENT).alias("_defined"))
    out = out.join(heads, "iri", "left").join(members, "iri", "left").join(owners, "iri", "left")
    named = ~m.is_bnode(F.col("iri"))
    k = F.col("kind")
    step = (F.when(F.col("_head") & ~named, "Intersection")
            .when(F.col("_head") & k.isin("Class", "Resource"), "Defined")
            .when(F.col("_member") & named & (k == "Resource"), "Class")
            .when(F.col("_defined").isNotNull() & named & (k == "Resource"), "Class").otherwise(k))
    final = F.when(F.col("_defined") & named & step.isin("Class", "Defined"), "Defined").otherwise(step)
    return cut(out.select("iri", final.alias("kind")))


def project_entities(quads: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per entity: name, label, comment and the first domain, range
    and inverse.  A single grouped pass over the statements."""
    def first(p: str, literal: bool) -> Column:
        want = (F.col("p") == p) & (m.is_literal() if literal else m.is_resource())
        return F.min_by(F.when(want, F.col("o")), F.when(want, F.struct("pos", "o")))

    facts = quads.filter(F.col("p").isin(m.COMMENT, m.DOMAIN, m.RANGE, m.OWL + "inverseOf")).groupBy(
        F.col("s").alias("iri")).agg(
        first(m.COMMENT, True).alias("comment"), first(m.DOMAIN, False).alias("domain"),
        first(m.RANGE, False).alias("range"), first(m.OWL + "inverseOf", False).alias("inverse"))
    labels = preferred_label(quads)
    out = kinds.join(labels, "iri", "left").join(facts, "iri", "left")
    return out.select(
        "iri", "kind", F.coalesce("label", tx.local_name(F.col("iri"))).alias("name"), "label",
        F.col("lang").alias("label_lang"), F.coalesce("comment", F.lit("")).alias("comment"),
        "domain", "range", "inverse")


def entity_parents(quads: DataFrame, kinds: DataFrame) -> DataFrame:
    """Asserted named parents (src, dst, pos): superproperties of a property,
    superclasses of anything else."""
    rows = quads.filter(F.col("p").isin(m.SUBCLASS, m.SUBPROPERTY) & (F.col("o_kind") == "iri"))
    prop = kinds.filter(F.col("kind").isin(m.PROPERTY_KINDS)).select(F.col("iri").alias("s"), F.lit(True).alias("_prop"))
    rows = rows.join(prop, "s", "left")
    fits = F.when(F.col("_prop"), F.col("p") == m.SUBPROPERTY).otherwise(F.col("p") == m.SUBCLASS)
    return rows.filter(fits).groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.min("pos").alias("pos"))


def characteristics(quads: DataFrame) -> DataFrame:
    """(iri, characteristic) such as functional, transitive."""
    plain = [m.OWL + n for n in ("ObjectProperty", "DatatypeProperty", "AnnotationProperty")]
    rows = quads.filter((F.col("p") == m.TYPE) & m.is_resource() & F.col("o").startswith(m.OWL)
                        & F.col("o").endswith("Property") & ~F.col("o").isin(plain))
    name = F.lower(F.regexp_extract("o", r"#(.*)Property$", 1))
    return rows.select(F.col("s").alias("iri"), name.alias("characteristic")).distinct()


def restrictions(quads: DataFrame) -> DataFrame:
    """OWL restrictions behind subClassOf / equivalentClass, one row each:
    ``(iri, relation, expr, property, quantifier, filler, cardinality)``."""
    p = F.col("p")
    tests = [m.OWL + q for q in QUANTIFIERS]
    on_property = F.when(p == m.OWL + "onProperty", F.struct("pos", "o"))
    quantified = F.when(p.isin(tests), F.struct("pos", "p", "o", "o_kind"))
    bodies = quads.filter(p.isin([m.OWL + "onProperty", *tests])).groupBy(F.col("s").alias("expr")).agg(
        F.min(on_property).alias("prop"), F.min(quantified).alias("q")).filter("prop is not null and q is not null")
    owners = quads.filter(p.isin(m.SUBCLASS, m.EQUIVALENT) & m.is_resource()).select(
        F.col("s").alias("iri"), p.alias("relation"), F.col("o").alias("expr"))
    rows = owners.join(bodies, "expr")
    literal = F.col("q.o_kind") == "literal"
    return rows.select(
        "iri", "relation", "expr", F.col("prop.o").alias("property"),
        _lookup({m.OWL + k: v for k, v in QUANTIFIERS.items()}, F.col("q.p")).alias("quantifier"),
        F.when(~literal, F.col("q.o")).alias("filler"),
        F.when(literal & F.col("q.o").rlike(r"^\d+$"), F.col("q.o").try_cast("long")).alias("cardinality"))


def flatten_restrictions(rows: DataFrame) -> DataFrame:
    """Direct links (src, pred, dst) implied by ``some`` and ``value``."""
    return rows.filter(F.col("quantifier").isin("some", "value") & F.col("filler").isNotNull()).select(
        F.col("iri").alias("src"), F.col("property").alias("pred"), F.col("filler").alias("dst")).distinct()


# -- lists and conjunctions -------------------------------------------------

def rdf_lists(quads: DataFrame, heads: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Flatten RDF lists: members ``(g, head, pos, cell, member)`` and
    ``(g, head, issue)``.

    ``heads(g, head)``.  Pointer doubling: round k appends the cells 2^k to
    2^(k+1)-1 steps away, so a list of 4096 cells takes 12 rounds.  With a
    ``limit``, longer lists are an issue of that name.
    """
    in_list = quads.filter(F.col("p").isin(m.FIRST, m.REST)).withColumn("g", F.coalesce("g", F.lit("")))
    is_first, is_rest = F.col("p") == m.FIRST, F.col("p") == m.REST
    cells = in_list.groupBy("g", F.col("s").alias("cell")).agg(
        F.count_if(is_first).alias("nf"), F.count_if(is_rest).alias("nr"), F.count_if(m.is_literal()).alias("nl"),
        F.max(F.when(is_first, F.col("o"))).alias("member"), F.max(F.when(is_rest, F.col("o"))).alias("rest"))
    cells = cut(cells.withColumn("ok", (F.col("nf") == 1) & (F.col("nr") == 1) & (F.col("nl") == 0))
                .select("g", "cell", "member", "rest", "ok"))
    jump = cells.filter(F.col("ok") & (F.col("rest") != m.NIL)).select("g", "cell", F.col("rest").alias("nxt"))
    own = cut(heads.select(F.coalesce("g", F.lit("")).alias("g"), "head").distinct())
    rows = own.filter(F.col("head") != m.NIL).select("g", "head", F.col("head").alias("cell"), F.lit(0).alias("pos"))
    issues = own.limit(0).withColumn("issue", F.lit(""))
    width = 1
    while True:
        more = cut(rows.join(jump, ["g", "cell"]).select(
            "g", "head", F.col("nxt").alias("cell"), (F.col("pos") + width).alias("pos")))
        if more.isEmpty():
            break
        rows = cut(rows.unionByName(more))
        twice = rows.groupBy("g", "head", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        long = rows.limit(0) if limit is None else rows.filter(F.col("pos") >= limit)
        bad = cut(twice.select("g", "head", F.lit("cycle").alias("issue")).unionAll(
            long.select("g", "head", F.lit("limit").alias("issue"))).groupBy("g", "head").agg(F.min("issue").alias("issue")))
        issues = issues.unionByName(bad)
        rows = cut(rows.join(bad, ["g", "head"], "left_anti"))
        jump = cut(jump.join(jump.select("g", F.col("cell").alias("nxt"), F.col("nxt").alias("_far")), ["g", "nxt"])
                   .select("g", "cell", F.col("_far").alias("nxt")))
        width *= 2
    full = rows.join(cells, ["g", "cell"], "left")
    broken = full.filter(~F.coalesce("ok", F.lit(False))).select("g", "head", F.lit("incomplete").alias("issue")).distinct()
    members = full.join(broken, ["g", "head"], "left_anti").select("g", "head", "pos", "cell", "member")
    return members, issues.unionByName(broken)


def intersections(quads: DataFrame) -> DataFrame:
    """Conjunction members ``(expr, g, pos, cell, member, issue)``; an expression with an
    issue has one row and no member."""
    heads = quads.filter(F.col("p") == m.INTERSECTION)
    per = heads.groupBy(F.col("s").alias("expr")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(m.is_literal()).alias("lit"),
        F.min("o").alias("head"), F.min(F.coalesce("g", F.lit(""))).alias("g"))
    per = cut(per)
    clear = per.filter("n = 1 and lit = 0")
    members, issues = rdf_lists(quads, clear.select("g", "head"))
    good = clear.join(members, ["g", "head"]).select(
        "expr", "g", "pos", "cell", "member", F.lit(None).cast("string").alias("issue"))
    nothing = [F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("cell"),
               F.lit(None).cast("string").alias("member")]
    bad = clear.join(issues, ["g", "head"]).select("expr", "g", *nothing, "issue")
    vague = per.filter("n <> 1 or lit <> 0").select("expr", "g", *nothing, F.lit("ambiguous").alias("issue"))
    return cut(good.unionByName(bad).unionByName(vague))


def expression_references(quads: DataFrame, conj: DataFrame) -> DataFrame:
    """(owner, expr, relation): named owners of a conjunction; equivalentClass
    counts in both directions."""
    rows = quads.filter(F.col("p").isin(m.SUBCLASS, m.EQUIVALENT) & m.is_resource())
    there = rows.select(F.col("s").alias("owner"), F.col("o").alias("expr"), F.col("p").alias("relation"))
    back = rows.filter(F.col("p") == m.EQUIVALENT).select(
        F.col("o").alias("owner"), F.col("s").alias("expr"), F.col("p").alias("relation"))
    known = conj.select("expr").distinct()
    refs = there.unionAll(back).filter(~m.is_bnode(F.col("owner"))).distinct()
    return refs.join(known, "expr", "left_semi")


def _owned(quads: DataFrame, conj: DataFrame) -> DataFrame:
    """References plus the classes that are a conjunction themselves."""
    refs = expression_references(quads, conj)
    own = conj.filter(~m.is_bnode(F.col("expr"))).select(
        F.col("expr").alias("owner"), "expr", F.lit(m.EQUIVALENT).alias("relation")).distinct()
    return refs.unionByName(own)


def _nested(conj: DataFrame, follow: DataFrame) -> DataFrame:
    """(expr, member): members reached through nested conjunctions in ``follow(expr)``."""
    direct = conj.filter("issue is null").select("expr", "member").distinct()
    inner = follow.select(F.col("expr").alias("member"))
    links = direct.join(inner, "member", "left_semi").select(F.col("expr").alias("src"), F.col("member").alias("dst"))
    below = reach(links).select(F.col("start").alias("top"), F.col("node").alias("expr"))
    own = direct.select(F.col("expr").alias("top"), "expr").distinct()
    every = own.unionAll(below.select("top", "expr")).distinct().join(direct, "expr")
    return every.join(inner, "member", "left_anti").select(F.col("top").alias("expr"), "member").distinct()


def taxonomy_edges(quads: DataFrame, kinds: DataFrame, conj: DataFrame) -> DataFrame:
    """Child-to-parent edges of named classes (src, dst): asserted parents
    and the named members of conjunctions, however nested.  Restrictions
    never become parents."""
    named = kinds.filter(F.col("kind").isin("Class", "Defined") & ~m.is_bnode(F.col("iri"))).select("iri")
    follow = conj.select("expr").distinct().join(named.withColumnRenamed("iri", "expr"), "expr", "left_anti")
    members = _nested(conj, follow).join(named.withColumnRenamed("iri", "member"), "member", "left_semi")
    implied = _owned(quads, conj).join(members, "expr").select(F.col("owner").alias("src"), F.col("member").alias("dst"))
    through = _owned(quads, conj).join(named.withColumnRenamed("iri", "expr"), "expr", "left_semi").select(
        F.col("owner").alias("src"), F.col("expr").alias("dst"))
    implied = implied.unionAll(through).join(named.withColumnRenamed("iri", "src"), "src", "left_semi")
    asserted = entity_parents(quads, kinds).select("src", "dst")
    return asserted.unionByName(implied).filter("src <> dst").distinct()


def intersection_edges(quads: DataFrame, conj: DataFrame) -> DataFrame:
    """Branches (owner, relation, expr, member) with anonymous conjunctions
    flattened and other members kept as they are."""
    follow = conj.filter(m.is_bnode(F.col("expr"))).select("expr").distinct()
    members = _nested(conj, follow)
    owned = _owned(quads, conj).filter(m.is_bnode(F.col("expr")) | (F.col("expr") == F.col("owner")))
    return owned.join(members, "expr").filter("member <> owner").select("owner", "relation", "expr", "member").distinct()


def labels(quads: DataFrame) -> DataFrame:
    """(iri, label): preferred label, else the humanised local name."""
    iris = quads.select(F.explode(F.when(m.is_resource(), F.array("s", "o")).otherwise(F.array("s"))).alias("iri")).distinct()
    best = preferred_label(quads).select("iri", "label")
    return iris.join(best, "iri", "left").select(
        "iri", F.coalesce("label", tx.humanise(tx.local_name(F.col("iri")))).alias("label"))


def expression_labels(quads: DataFrame, conj: DataFrame) -> DataFrame:
    """(iri, label) of anonymous expressions: ``p some X`` or Intersection."""
    named = labels(quads)
    rows = restrictions(quads).select("expr", "property", "quantifier", "filler", "cardinality").distinct()
    rows = (rows.join(named.select(F.col("iri").alias("property"), F.col("label").alias("_p")), "property", "left")
            .join(named.select(F.col("iri").alias("filler"), F.col("label").alias("_f")), "filler", "left"))
    text = F.concat_ws(" ", F.coalesce("_p", tx.local_name(F.col("property"))), "quantifier",
                       F.coalesce("_f", F.col("cardinality").cast("string")))
    return rows.select(F.col("expr").alias("iri"), text.alias("label")).unionAll(
        conj.groupBy(F.col("expr").alias("iri")).agg(F.when(
            F.max("issue").isNotNull(), "Intersection (check source)").otherwise("Intersection").alias("label"))
        .filter(m.is_bnode(F.col("iri"))))


# -- rewriting --------------------------------------------------------------

def _annotated(quads: DataFrame) -> DataFrame:
    return quads.filter((F.col("p") == m.OWL + "annotatedTarget") & m.is_resource()).select(F.col("o").alias("expr")).distinct()


def _structure(conj: DataFrame) -> DataFrame:
    """(expr, node): each valid anonymous conjunction and its list cells."""
    good = conj.filter(F.col("issue").isNull() & m.is_bnode(F.col("expr")))
    return good.select("expr", F.explode(F.array("expr", "cell")).alias("node")).distinct()


def _untidy(quads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(expr): structures that carry anything beyond the bare list."""
    rows = nodes.join(quads, F.col("node") == F.col("s"))
    extra = ~F.col("p").isin(m.TYPE, m.INTERSECTION, m.FIRST, m.REST) | (
        (F.col("p") == m.TYPE) & ~F.col("o").isin(m.OWL + "Class", m.RDF + "List"))
    named_cell = nodes.filter(~m.is_bnode(F.col("node"))).select("expr")
    return rows.filter(extra).select("expr").unionAll(named_cell).distinct()


def simple_parent_expressions(quads: DataFrame, kinds: DataFrame, conj: DataFrame) -> DataFrame:
    """(expr, member) of conjunctions plain enough to show as named parents."""
    named = kinds.filter(F.col("kind").isin("Class", "Defined") & ~m.is_bnode(F.col("iri"))).select(F.col("iri").alias("member"))
    used = quads.filter((F.col("p") == m.SUBCLASS) & (F.col("o_kind") == "bnode")).select(F.col("o").alias("expr")).distinct()
    good = conj.filter("issue is null").join(used, "expr", "left_semi").join(_annotated(quads), "expr", "left_anti")
    other = good.join(named, "member", "left_anti").select("expr").distinct()
    good = good.join(other, "expr", "left_anti").join(_untidy(quads, _structure(conj)), "expr", "left_anti")
    return good.select("expr", "member").distinct()


def drop_orphan_lists(quads: DataFrame, conj: DataFrame, exprs: DataFrame) -> DataFrame:
    """Remove the list structure of ``exprs(expr)`` when it is plain and
    nothing outside it refers to it."""
    nodes = cut(_structure(conj).join(exprs, "expr", "left_semi"))
    inside = nodes.select("expr", F.col("node").alias("s"), F.lit(True).alias("_in"))
    refs = (quads.filter(m.is_resource()).select("s", F.col("o").alias("node")).join(nodes, "node")
            .join(inside, ["expr", "s"], "left").filter("_in is null").select("expr"))
    kept = refs.unionAll(_untidy(quads, nodes)).distinct()
    gone = nodes.join(kept, "expr", "left_anti").select(F.col("node").alias("s")).distinct()
    return quads.join(gone, "s", "left_anti").select(*quads.columns)


def simplify_subclass_intersections(quads: DataFrame, conj: DataFrame) -> DataFrame:
    """Rewrite ``C subClassOf (A and B)`` to one statement per member when the
    conjunction is anonymous, plain and unannotated; drop its list if unused."""
    plain = (conj.filter(F.col("issue").isNull() & m.is_bnode(F.col("expr"))).select("expr").distinct()
             .join(_annotated(quads), "expr", "left_anti"))
    only = quads.filter(~F.col("p").isin(m.TYPE, m.INTERSECTION)).select(F.col("s").alias("expr")).distinct()
    plain = cut(plain.join(only, "expr", "left_anti"))
    members = cut(_nested(conj.join(plain, "expr", "left_semi"), plain))
    sub = F.col("p") == m.SUBCLASS
    target = members.select(F.col("expr").alias("o"), "member")
    rewritten = quads.filter(sub & (F.col("o_kind") == "bnode")).join(target, "o").select(
        "s", "p", F.col("member").alias("o"), F.when(m.is_bnode(F.col("member")), "bnode").otherwise("iri").alias("o_kind"),
        "o_datatype", "o_lang", "g", "pos")
    exprs = members.select("expr").distinct()
    kept = quads.join(exprs.select(F.col("expr").alias("o"), F.lit(m.SUBCLASS).alias("p")), ["o", "p"], "left_anti").select(*m.QUAD_COLS)
    out = kept.unionByName(rewritten).groupBy(*m.STATEMENT).agg(F.min("pos").alias("pos"))
    return drop_orphan_lists(out, conj, exprs)


def drop_redundant_thing(quads: DataFrame) -> DataFrame:
    """owl:Thing goes as a parent of classes that have another superclass."""
    sub = (F.col("p") == m.SUBCLASS) & m.is_resource()
    specific = quads.filter(sub & (F.col("o") != m.THING)).select("s").distinct()
    top = quads.filter(sub & (F.col("o") == m.THING))
    rest = quads.filter(~F.coalesce(sub & (F.col("o") == m.THING), F.lit(False)))
    return rest.unionByName(top.join(specific, "s", "left_anti").select(*rest.columns))


# Predicates whose object must be a resource.
RESOURCE_PREDICATES = [m.TYPE, m.SUBCLASS, m.SUBPROPERTY, m.DOMAIN, m.RANGE] + [
    m.OWL + n for n in ("equivalentClass", "disjointWith", "inverseOf", "equivalentProperty", "sameAs", "differentFrom")]


def malformed_objects(quads: DataFrame, kinds: DataFrame) -> DataFrame:
    """Literal objects where a resource is expected."""
    props = kinds.filter(F.col("kind") == "ObjectProperty").select(F.col("iri").alias("p"), F.lit(True).alias("_op"))
    rows = quads.filter(m.is_literal() & ~F.col("p").isin(m.LABEL, m.COMMENT)).join(props, "p", "left")
    return rows.filter(F.col("p").isin(RESOURCE_PREDICATES) | F.col("_op")).select(*quads.columns)
