"""Ontology quality review: one grouped pass yields every per-entity check.

``scan`` returns *checks* ``(rule, iri, fails)``, one row per rule that applies
to an entity.  Statements are grouped by subject once, with one conditional
count per rule; only rules that look across entities (shared names,
references, cycles, components) add a join.  Evidence is a separate long
table, because one shared label may involve a third of all entities.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.functions import text as tx
from quadrille.operators import taxonomy as tax
from quadrille.session import cut

IAO = m.OBO + "IAO_"

# Rule id, group, default severity, on by default, vocabulary it needs.
RULES: list[tuple[str, str, str, bool, str | None]] = [
    ("label.missing", "Completeness", "Warning", True, None),
    ("label.empty", "Naming", "Warning", True, None),
    ("label.whitespace", "Naming", "Warning", True, None),
    ("label.placeholder", "Naming", "Warning", True, None),
    ("label.duplicate", "Naming", "Warning", True, None),
    ("label.multiple", "Naming", "Warning", True, None),
    ("label.language", "Completeness", "Information", True, None),
    ("label.style", "Naming", "Information", False, None),
    ("skos.multiple", "Naming", "Violation", True, "SKOS"),
    ("skos.disjoint", "Naming", "Violation", True, "SKOS"),
    ("skos.literal", "Naming", "Violation", True, "SKOS"),
    ("description.missing", "Completeness", "Information", True, None),
    ("definition.missing", "Completeness", "Information", True, None),
    ("description.repeated", "Completeness", "Information", True, None),
    ("definition.duplicate", "Completeness", "Warning", True, None),
    ("documentation.missing", "Completeness", "Information", False, None),
    ("alias.missing", "Completeness", "Information", False, None),
    ("alias.empty", "Naming", "Warning", True, None),
    ("alias.primary", "Naming", "Information", True, None),
    ("alias.shared", "Naming", "Warning", True, None),
    ("alias.legacy", "Naming", "Information", False, None),
    ("structure.component", "Structure", "Information", True, None),
    ("structure.isolated", "Structure", "Warning", True, None),
    ("structure.parent", "Structure", "Information", True, None),
    ("structure.cycle", "Structure", "Warning", True, None),
    ("structure.declaration", "Structure", "Warning", True, None),
    ("structure.type", "Structure", "Warning", True, None),
    ("structure.unresolved", "Structure", "Warning", True, None),
    ("property.domain", "Structure", "Information", True, None),
    ("property.range", "Structure", "Information", True, None),
    ("property.multiple", "Structure", "Information", True, None),
    ("deprecated.boolean", "Retired entities", "Violation", True, "owl:deprecated"),
    ("deprecated.reference", "Retired entities", "Warning", True, "owl:deprecated"),
    ("deprecated.guidance", "Retired entities", "Warning", True, "owl:deprecated"),
    ("metadata.missing", "Publication metadata", "Information", True, None),
    ("analysis.excluded", "Text Analysis compatibility", "Information", True, None),
]
RULE_IDS = [r[0] for r in RULES]
PROVENANCE = [m.DCTERMS + "source", m.DC + "source", m.DCTERMS + "provenance", m.PROV + "wasDerivedFrom"]


@dataclass
class Options:
    """What to scan and which predicates count as names and descriptions."""
    namespace: str = ""
    root: str = ""
    kinds: list[str] = field(default_factory=lambda: [
        "Class", "Defined", "Individual", *m.PROPERTY_KINDS, "Resource", "Datatype"])
    groups: list[str] = field(default_factory=lambda: sorted({r[1] for r in RULES}))
    severities: dict[str, str] = field(default_factory=lambda: {r[0]: r[2] if r[3] else "Off" for r in RULES})
    labels: list[str] = field(default_factory=lambda: [m.LABEL, m.PREF])
    descriptions: list[str] = field(default_factory=lambda: [
        m.COMMENT, m.SKOS + "definition", m.DCTERMS + "description", IAO + "0000115"])
    definitions: list[str] = field(default_factory=lambda: [m.SKOS + "definition", IAO + "0000115"])
    replacements: list[str] = field(default_factory=lambda: [
        m.DCTERMS + "isReplacedBy", IAO + "0100001", "http://www.geneontology.org/formats/oboInOwl#consider"])
    languages: list[str] = field(default_factory=list)


def built_in(c: Column) -> Column:
    out = F.lit(False)
    for base in (m.RDF, m.RDFS, m.OWL, m.XSD, m.SKOS, m.DC, m.DCTERMS):
        out = out | c.startswith(base)
    return out


def _text() -> Column:
    return m.is_literal() & (F.trim("o") != "")


def _lang() -> Column:
    return F.lower(F.coalesce("o_lang", F.lit("")))


def _norm() -> Column:
    return F.lower(F.trim("o"))


def is_alias() -> Column:
    return (F.col("p").isin(m.ALT, m.SKOS + "hiddenLabel", m.SEE_ALSO)
            | (F.substring_index("p", "#", -1) == "inflection"))


def _filled(predicates: list[str]) -> Column:
    return F.col("p").isin(predicates) & (_text() | m.is_resource())


def _lexical() -> Column:
    plain = F.when(_lang() != "", m.RDF + "langString").otherwise(m.XSD + "string")
    return F.struct(F.col("o").alias("v"), _lang().alias("l"), F.coalesce("o_datatype", plain).alias("d"), F.col("o_kind").alias("k"))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# -- scope and vocabularies -------------------------------------------------

def candidates(quads: DataFrame, entities: DataFrame, parents: DataFrame, options: Options) -> DataFrame:
    """Named, not built-in entities with statements, inside the scope."""
    subjects = quads.select(F.col("s").alias("iri")).distinct()
    ontologies = quads.filter((F.col("p") == m.TYPE) & (F.col("o") == m.OWL + "Ontology")).select(F.col("s").alias("iri")).distinct()
    out = (entities.filter(~m.is_bnode(F.col("iri")) & ~built_in(F.col("iri")) & F.col("kind").isin(options.kinds))
           .join(subjects, "iri", "left_semi").join(ontologies, "iri", "left_anti"))
    if options.namespace:
        out = out.filter(tx.namespace(F.col("iri")) == options.namespace)
    if options.root:
        classes = entities.filter(F.col("kind").isin("Class", "Defined"))
        out = out.join(tax.branch_members(parents, options.root, classes), "iri", "left_semi")
    return out.select("iri", "kind", "label")


def census(quads: DataFrame) -> DataFrame:
    """(vocabulary) in use, as a predicate or as a type object."""
    used = quads.select(F.col("p").alias("iri")).unionAll(
        quads.filter((F.col("p") == m.TYPE) & m.is_resource()).select("o")).distinct()
    iri = F.col("iri")
    found = F.explode(F.array_compact(F.array(
        F.when(iri.startswith(m.RDFS), "RDFS"), F.when(iri.startswith(m.OWL), "OWL"),
        F.when(iri == m.OWL + "deprecated", "owl:deprecated"), F.when(iri.startswith(m.SKOS), "SKOS"),
        F.when(iri.startswith(m.DC) | iri.startswith(m.DCTERMS), "Dublin Core"), F.when(iri.startswith(IAO), "IAO"))))
    return used.select(found.alias("vocabulary")).distinct()


def rule_table(df: DataFrame) -> DataFrame:
    """The rule catalogue as rows, built from constants in one expression."""
    rows = F.explode(F.array(*[F.struct(
        F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("group"), F.lit(r[2]).alias("severity"),
        F.lit(r[3]).alias("enabled"), F.lit(r[4]).cast("string").alias("requires")) for r in RULES]))
    return df.sparkSession.range(1).select(rows.alias("r")).select("r.*")


def admitted_rules(quads: DataFrame) -> DataFrame:
    """The catalogue with ``withdrawn`` set where the vocabulary is absent."""
    rules = rule_table(quads).join(census(quads).withColumnRenamed("vocabulary", "requires").withColumn("_seen", F.lit(True)),
                                   "requires", "left")
    return rules.withColumn("withdrawn", F.col("requires").isNotNull() & F.col("_seen").isNull()).drop("_seen")


def admitted_predicates(predicates: DataFrame, quads: DataFrame) -> DataFrame:
    """Predicates whose vocabulary is in use (RDFS and OWL always are)."""
    p = F.col("p")
    need = (F.when(p == m.OWL + "deprecated", "owl:deprecated").when(p.startswith(m.SKOS), "SKOS")
            .when(p.startswith(m.DC) | p.startswith(m.DCTERMS), "Dublin Core").when(p.startswith(IAO), "IAO"))
    rows = predicates.withColumn("vocabulary", need)
    seen = census(quads).withColumn("_seen", F.lit(True))
    return rows.join(seen, "vocabulary", "left").filter("vocabulary is null or _seen").select("p")


# -- checks -----------------------------------------------------------------

def _own_facts(stmts: DataFrame, o: Options) -> DataFrame:
    """Conditional counts per subject: the single pass."""
    p, text, res = F.col("p"), _text(), m.is_resource()
    label, retired = p.isin(o.labels), p == m.OWL + "deprecated"
    valid = label & text
    skos = p.isin(m.PREF, m.ALT, m.SKOS + "hiddenLabel")
    alt = is_alias() & m.is_literal()
    typed = (p == m.TYPE) & res
    n = F.count_if
    classes = [m.OWL + "Class", m.RDFS + "Class"]
    props = [m.OWL + "ObjectProperty", m.OWL + "DatatypeProperty", m.OWL + "AnnotationProperty", m.RDF + "Property"]
    notes = [m.SKOS + x for x in ("example", "scopeNote", "editorialNote", "historyNote", "changeNote")]
    dom, ran = F.when(p == m.DOMAIN, _lexical()), F.when(p == m.RANGE, _lexical())
    counts = {
        "labels": n(label), "valid": n(valid), "bad": n(label & ~text), "padded": n(valid & (F.col("o") != F.trim("o"))),
        "stub": n(valid & tx.is_placeholder(F.concat(F.lit("urn:"), F.regexp_replace("o", r"\s+", "")))),
        "styled": n(valid & F.col("o").rlike("_|[a-z][A-Z]")),
        "skos": n(skos), "pref": n((p == m.PREF) & text),
        "skos_bad": n(skos & (res | ~F.coalesce("o_datatype", F.lit(m.XSD + "string")).isin(m.XSD + "string", m.RDF + "langString"))),
        "descriptions": n(_filled(o.descriptions)), "definitions": n(_filled(o.definitions)), "notes": n(_filled(notes)),
        "raw": n((p == m.LABEL) & text), "alts": n(alt), "alts_ok": n(alt & text),
        "legacy": n(alt & (p == m.SEE_ALSO)), "links": n(res & (p != m.TYPE) & ~built_in(F.col("o"))),
        "supers": n((p == m.SUBCLASS) & res), "decl_class": n(typed & F.col("o").isin(classes)),
        "decl_prop": n(typed & F.col("o").isin(props)), "decl_type": n(typed & (F.col("o") == m.RDFS + "Datatype")),
        "domain_class": n(typed & ~built_in(F.col("o"))), "domains": n(p == m.DOMAIN), "ranges": n(p == m.RANGE),
        "many_domains": _flag(F.min(dom) != F.max(dom)), "many_ranges": _flag(F.min(ran) != F.max(ran)),
        "retired": n(retired), "is_retired": n(retired & m.is_literal() & F.trim("o").isin("true", "1") & (F.col("o_datatype") == m.XSD + "boolean")),
        "retired_bad": n(retired & (res | ~_flag(F.col("o_datatype") == m.XSD + "boolean") | ~F.trim("o").isin("true", "false", "1", "0"))),
        "guided": n(_filled([*o.replacements, m.COMMENT])),
        "nameable": n(p.isin(m.LABEL, m.SEE_ALSO, m.ALT) | (F.substring_index("p", "#", -1) == "inflection")),
    }
    for i, lang in enumerate(o.languages):
        counts[f"in_{i}"] = n(valid & (_lang() == lang.lower()))
    return stmts.groupBy(F.col("s").alias("iri")).agg(*[c.alias(k) for k, c in counts.items()])


def _per_language(stmts: DataFrame) -> DataFrame:
    """(iri, two_labels, two_prefs): more than one value in one language."""
    rows = stmts.filter(F.col("p").isin(m.LABEL, m.PREF) & _text())
    per = rows.groupBy("s", "p", _lang().alias("l")).agg((F.min(_lexical()) != F.max(_lexical())).alias("many"))
    return per.groupBy(F.col("s").alias("iri")).agg(
        F.max(F.col("many") & (F.col("p") == m.LABEL)).alias("two_labels"),
        F.max(F.col("many") & (F.col("p") == m.PREF)).alias("two_prefs"))


def shared_names(stmts: DataFrame, o: Options) -> DataFrame:
    """Names per entity with their roles and how many entities use each role:
    ``(iri, norm, lang, label, alias, definition, description, n_label, ...)``."""
    p = F.col("p")
    rows = stmts.filter(_text() & (p.isin(o.labels + o.descriptions + o.definitions) | is_alias()))
    own = rows.groupBy(F.col("s").alias("iri"), _norm().alias("norm"), _lang().alias("lang")).agg(
        F.max(p.isin(o.labels)).alias("is_label"), F.max(is_alias()).alias("is_alias"),
        F.max(p.isin(o.definitions)).alias("is_definition"), F.max(p.isin(o.descriptions)).alias("is_description"))
    own = cut(own)
    uses = own.groupBy("norm", "lang").agg(
        F.count_if("is_label").alias("n_label"), F.count_if("is_alias").alias("n_alias"),
        F.count_if("is_definition").alias("n_definition"),
        F.count_if(F.col("is_alias") | F.col("is_label")).alias("n_name"))
    # only names with more than one user travel back, so the join side is small
    uses = uses.filter("n_label > 1 or n_definition > 1 or n_name > 1")
    return own.join(uses, ["norm", "lang"], "left").fillna(0, ["n_label", "n_alias", "n_definition", "n_name"])


def _name_facts(stmts: DataFrame, selected: DataFrame, o: Options) -> DataFrame:
    names = shared_names(stmts, o).join(selected.select("iri", F.lower(F.trim("label")).alias("_shown")), "iri", "left")
    mx = F.max
    return names.groupBy("iri").agg(
        mx(F.col("is_label") & (F.col("n_label") > 1)).alias("dup_label"),
        mx(F.col("is_definition") & (F.col("n_definition") > 1)).alias("dup_definition"),
        mx(F.col("is_alias") & (F.col("n_name") > 1)).alias("shared_alias"),
        mx(F.col("is_alias") & F.col("is_label")).alias("alias_is_label"),
        mx(F.col("is_description") & (F.col("is_label") | _flag(F.col("norm") == F.col("_shown")))).alias("echo"))


def _skos_conflicts(stmts: DataFrame) -> DataFrame:
    rows = stmts.filter(F.col("p").isin(m.PREF, m.ALT, m.SKOS + "hiddenLabel") & m.is_literal())
    roles = rows.groupBy("s", _lexical().alias("x")).agg((F.min("p") != F.max("p")).alias("two"))
    return roles.groupBy(F.col("s").alias("iri")).agg(F.max("two").alias("role_conflict"))


def _reference_facts(quads: DataFrame, stmts: DataFrame) -> DataFrame:
    """(iri, unresolved, to_retired).  Distinct targets are judged first, so a
    hub target is looked up once, not once per reference."""
    ref = F.explode(F.when(m.is_resource(), F.array("p", "o")).otherwise(F.array("p")))
    refs = cut(stmts.select(F.col("s").alias("iri"), ref.alias("t")).distinct())
    subjects = quads.select(F.col("s").alias("t")).distinct()
    targets = refs.select("t").distinct()
    undefined = targets.filter(~m.is_bnode(F.col("t")) & ~built_in(F.col("t"))).join(subjects, "t", "left_anti")
    retired = quads.filter((F.col("p") == m.OWL + "deprecated") & m.is_literal() & F.trim("o").isin("true", "1")
                           & (F.col("o_datatype") == m.XSD + "boolean")).select(F.col("s").alias("t")).distinct()
    bad = undefined.withColumn("u", F.lit(True)).join(retired.withColumn("r", F.lit(True)), "t", "full")
    return refs.join(bad, "t").groupBy("iri").agg(
        F.max(_flag(F.col("u"))).alias("unresolved"), F.max(_flag(F.col("r"))).alias("to_retired"))


def _incoming(quads: DataFrame) -> DataFrame:
    links = quads.filter(m.is_resource() & (F.col("p") != m.TYPE)).select(F.col("o").alias("iri"))
    return links.unionAll(quads.select("p")).distinct().withColumn("reached", F.lit(True))


def component_facts(selected: DataFrame, parents: DataFrame, inside: bool = True) -> DataFrame:
    """(iri, component, members) for the named classes selected; the finding
    of a component sits on its first member.

    With ``inside`` only links between selected classes connect.  Without it
    links through other classes, such as undeclared parents, do too; those may
    name a component, but do not count as members.
    """
    classes = selected.filter(F.col("kind").isin("Class", "Defined")).select("iri")
    links = parents.select("src", "dst")
    if inside:
        links = (links.join(classes.withColumnRenamed("iri", "src"), "src", "left_semi")
                 .join(classes.withColumnRenamed("iri", "dst"), "dst", "left_semi"))
    parts = tax.components(links, classes)
    if not inside:
        parts = parts.join(classes.withColumnRenamed("iri", "node"), "node", "left_semi")
    return cut(parts).groupBy("component").agg(F.count(F.lit(1)).alias("members"))


def stray_components(selected: DataFrame, parents: DataFrame, inside: bool = True) -> DataFrame:
    """(iri, stray): all components but the largest, see ``component_facts``."""
    sizes = cut(component_facts(selected, parents, inside))
    largest = sizes.agg(F.min(F.struct((-F.col("members")).alias("n"), "component"))["component"]).scalar()
    return sizes.filter(F.col("component") != largest).select(F.col("component").alias("iri"), F.lit(True).alias("stray"))


# rules that need more than the subject's own statements
_NEEDS = {
    "language": {"label.multiple", "skos.multiple"},
    "names": {"label.duplicate", "definition.duplicate", "alias.shared", "alias.primary", "description.repeated"},
    "roles": {"skos.disjoint"},
    "references": {"structure.unresolved", "deprecated.reference"},
    "incoming": {"structure.isolated"},
    "components": {"structure.component"},
    "cycles": {"structure.cycle"},
}


def scan(quads: DataFrame, entities: DataFrame, parents: DataFrame, options: Options | None = None,
         rules: list[str] | None = None) -> DataFrame:
    """All checks ``(rule, iri, kind, label, fails)`` that apply; see the module head.

    ``entities(iri, kind, label)``; ``parents(src, dst)`` named taxonomy edges.
    With ``rules`` only what those rules need is computed.
    """
    o = options or Options()
    wanted = set(rules or RULE_IDS)
    selected = cut(candidates(quads, entities, parents, o))
    stmts = cut(quads.join(selected.select(F.col("iri").alias("s")), "s", "left_semi"))
    parts = {
        "language": lambda: _per_language(stmts), "names": lambda: _name_facts(stmts, selected, o),
        "roles": lambda: _skos_conflicts(stmts), "references": lambda: _reference_facts(quads, stmts),
        "incoming": lambda: _incoming(quads), "components": lambda: stray_components(selected, parents),
        "cycles": lambda: tax.cyclic_nodes(parents).withColumn("cyclic", F.lit(True)),
    }
    facts = selected.join(_own_facts(stmts, o), "iri")
    for name, make in parts.items():
        if wanted & _NEEDS[name]:
            facts = facts.join(make(), "iri", "left")
    facts = cut(facts)
    valid = stmts.filter(F.col("p").isin(o.labels) & _text())
    styles = valid.agg(F.countDistinct(F.when(F.col("o").contains("_"), "underscore").when(
        F.col("o").rlike("[a-z][A-Z]"), "camel").otherwise("words"))).scalar()
    c, k = F.col, F.col("kind")
    yes = F.lit(True)
    is_class, is_prop = k.isin("Class", "Defined"), k.isin(m.PROPERTY_KINDS)
    missing_lang = F.lit(False)
    for i in range(len(o.languages)):
        missing_lang = missing_lang | (c(f"in_{i}") == 0)
    declared = F.when(is_class, c("decl_class")).when(is_prop, c("decl_prop")).otherwise(c("decl_type"))
    typed_prop = k.isin("ObjectProperty", "DataProperty")
    tests: dict[str, tuple[Column, Column]] = {
        "label.missing": (yes, c("labels") == 0),
        "label.empty": (c("labels") > 0, c("bad") > 0),
        "label.whitespace": (c("valid") > 0, c("padded") > 0),
        "label.placeholder": (yes, tx.is_placeholder(c("iri")) | (c("stub") > 0)),
        "label.duplicate": (c("valid") > 0, c("dup_label")),
        "label.multiple": (c("raw") > 0, c("two_labels")),
        "label.language": (F.lit(bool(o.languages)), missing_lang),
        "label.style": (c("valid") > 0, (c("styled") > 0) & (c("_styles") > 1)),
        "skos.multiple": (c("pref") > 0, c("two_prefs")),
        "skos.disjoint": (c("skos") > 0, c("role_conflict")),
        "skos.literal": (c("skos") > 0, c("skos_bad") > 0),
        "description.missing": (yes, c("descriptions") == 0),
        "definition.missing": (~k.isin("Individual", "Datatype"), c("definitions") == 0),
        "description.repeated": (c("descriptions") > 0, c("echo")),
        "definition.duplicate": (c("definitions") > 0, c("dup_definition")),
        "documentation.missing": (yes, c("notes") == 0),
        "alias.missing": (yes, c("alts_ok") == 0),
        "alias.empty": (c("alts") > 0, c("alts") > c("alts_ok")),
        "alias.primary": (c("alts") > 0, c("alias_is_label")),
        "alias.shared": (c("alts_ok") > 0, c("shared_alias")),
        "alias.legacy": (c("legacy") > 0, yes),
        "structure.component": (is_class, c("stray")),
        "structure.isolated": (is_class | is_prop, (c("links") == 0) & c("reached").isNull()),
        "structure.parent": (is_class, c("supers") == 0),
        "structure.cycle": (is_class, c("cyclic")),
        "structure.declaration": (is_class | is_prop | (k == "Datatype"), declared == 0),
        "structure.type": (k == "Individual", c("domain_class") == 0),
        "structure.unresolved": (yes, c("unresolved")),
        "property.domain": (typed_prop, c("domains") == 0),
        "property.range": (typed_prop, c("ranges") == 0),
        "property.multiple": (typed_prop, c("many_domains") | c("many_ranges")),
        "deprecated.boolean": (c("retired") > 0, c("retired_bad") > 0),
        "deprecated.reference": (yes, c("to_retired")),
        "deprecated.guidance": (c("is_retired") > 0, c("guided") == 0),
        "analysis.excluded": (yes, c("nameable") == 0),
    }
    rows = F.explode(F.filter(F.array(*[
        F.struct(F.lit(r).alias("rule"), a.alias("applies"), _flag(b).alias("fails"))
        for r, (a, b) in tests.items() if r in wanted]),
        lambda x: x["applies"]))
    return facts.withColumn("_styles", styles).select("iri", "kind", "label", rows.alias("r")).select(
        "r.rule", "iri", "kind", "label", "r.fails")


METADATA = {
    "title": [m.LABEL, m.DC + "title", m.DCTERMS + "title"],
    "version": [m.OWL + "versionIRI", m.OWL + "versionInfo"],
    "creator or maintainer": [m.DC + "creator", m.DCTERMS + "creator", m.DC + "publisher", m.DCTERMS + "publisher"],
    "license": [m.DCTERMS + "license", m.DC + "rights"],
    "provenance or source": PROVENANCE,
}


def ontology_metadata(quads: DataFrame, options: Options | None = None) -> DataFrame:
    """Per owl:Ontology subject the metadata fields it lacks."""
    o = options or Options()
    fields = {**METADATA, "description": o.descriptions}
    heads = quads.filter((F.col("p") == m.TYPE) & (F.col("o") == m.OWL + "Ontology")).select("s").distinct()
    per = quads.join(heads, "s", "left_semi").groupBy(F.col("s").alias("iri")).agg(
        *[F.count_if(_filled(ps)).alias(name) for name, ps in fields.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(f"`{name}`") == 0, name) for name in fields]))
    return per.select("iri", F.array_sort(missing).alias("missing"))


def active_findings(checks: DataFrame, quads: DataFrame, options: Options | None = None) -> DataFrame:
    """Failed checks of the rules that are switched on, in a chosen group and
    whose vocabulary the data uses."""
    o = options or Options()
    chosen = F.create_map(*[F.lit(x) for kv in o.severities.items() for x in kv])
    rules = admitted_rules(quads).filter(~F.col("withdrawn") & F.col("group").isin(o.groups))
    rules = rules.select("rule", "group", chosen[F.col("rule")].alias("severity")).filter("severity <> 'Off'")
    return (checks.filter("fails").join(rules, "rule").withColumn("namespace", tx.namespace(F.col("iri")))
            .select("rule", "severity", "group", "iri", "label", "kind", "namespace"))


def coverage(checks: DataFrame, quads: DataFrame) -> DataFrame:
    """Applicable, affected and not applicable entities per admitted rule."""
    scanned = checks.filter(F.col("rule") == "label.missing").agg(F.count(F.lit(1))).scalar()
    per = checks.groupBy("rule").agg(F.count(F.lit(1)).alias("applicable"), F.count_if("fails").alias("affected"))
    rules = admitted_rules(quads).filter("not withdrawn and rule <> 'metadata.missing'").select("rule")
    out = rules.join(per, "rule", "left").fillna(0, ["applicable", "affected"])
    return out.withColumn("not_applicable", scanned - F.col("applicable"))


def evidence(findings: DataFrame, quads: DataFrame, options: Options | None = None) -> DataFrame:
    """Own statements that support each finding, one row each."""
    o = options or Options()
    p, rule = F.col("p"), F.col("rule")
    defining = p.isin(m.SUBCLASS, m.EQUIVALENT)
    skos = p.isin(m.PREF, m.ALT, m.SKOS + "hiddenLabel")
    shows = (F.when(rule.isin("label.missing", "structure.isolated", "structure.declaration", "analysis.excluded"), F.lit(True))
             .when(rule == "label.empty", p.isin(o.labels) & ~_text())
             .when(rule == "label.whitespace", p.isin(o.labels) & (F.col("o") != F.trim("o")))
             .when(rule.startswith("label."), p.isin(o.labels)).when(rule == "skos.multiple", p == m.PREF)
             .when(rule.startswith("skos."), skos)
             .when(rule == "definition.duplicate", p.isin(o.definitions)).when(rule == "description.repeated", p.isin(o.descriptions))
             .when(rule == "alias.empty", is_alias() & ~_text()).when(rule == "alias.legacy", (p == m.SEE_ALSO) & m.is_literal())
             .when(rule.startswith("alias."), is_alias())
             .when(rule.isin("structure.component", "structure.cycle"), defining)
             .when(rule.isin("structure.parent", "structure.type"), p == m.TYPE)
             .when(rule == "structure.unresolved", m.is_resource())
             .when(rule == "property.multiple", p.isin(m.DOMAIN, m.RANGE))
             .when(rule == "deprecated.reference", m.is_resource())
             .when(rule.startswith("deprecated."), p == m.OWL + "deprecated").otherwise(F.lit(False)))
    rows = findings.select("rule", F.col("iri").alias("s")).join(quads, "s").filter(shows)
    return rows.select("rule", F.col("s").alias("iri"), *m.STATEMENT)


def fingerprints(findings: DataFrame, support: DataFrame) -> DataFrame:
    """SHA-256 signature per finding, stable under row order.

    Evidence enters as a count and an order-free sum of row digests, so it
    combines map-side and nothing is gathered.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in m.STATEMENT])), 1, 15), 16, 10)
    sums = support.groupBy("rule", "iri").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(digest.cast("decimal(20,0)")).alias("_d"))
    rows = findings.join(sums, ["rule", "iri"], "left").fillna(0, ["_n"])
    parts = [F.col("rule"), F.col("iri"), F.col("severity"), F.col("_n").cast("string"),
             F.coalesce(F.col("_d"), F.lit(0).cast("decimal(38,0)")).cast("string")]
    return rows.withColumn("signature", F.sha2(F.concat_ws("\u0001", *parts), 256)).withColumnRenamed("_n", "evidence").drop("_d")


def suppress(findings: DataFrame, exceptions: DataFrame, ontology: str) -> DataFrame:
    """Adds the reason of a recorded exception; the signature must still match."""
    own = exceptions.filter(F.col("ontology") == ontology).select("iri", "rule", "signature", F.col("reason").alias("exception"))
    own = own.dropDuplicates(["iri", "rule", "signature"])
    return findings.join(own, ["iri", "rule", "signature"], "left")


def label_corrections(findings: DataFrame, quads: DataFrame, options: Options | None = None) -> DataFrame:
    """Proposed label statements for missing labels: the humanised local name,
    in the entity's only graph (the default graph when it has several)."""
    o = options or Options()
    todo = findings.filter(F.col("rule") == "label.missing").select(F.col("iri").alias("s"))
    graphs = quads.join(todo, "s", "left_semi").groupBy("s").agg(
        F.min(F.coalesce("g", F.lit(""))).alias("_a"), F.max(F.coalesce("g", F.lit(""))).alias("_b"))
    rows = todo.join(graphs, "s", "left")
    graph = F.when((F.col("_a") == F.col("_b")) & (F.col("_a") != ""), F.col("_a"))
    lang = o.languages[0] if o.languages else None
    return m.literal_quads(rows, F.col("s"), F.lit(o.labels[0]), tx.humanise(tx.identifier_name(F.col("s"))),
                           F.lit(m.RDF + "langString" if lang else m.XSD + "string"), F.lit(lang), graph)


def check_repairs(repairs: DataFrame, findings: DataFrame, quads: DataFrame, options: Options | None = None) -> DataFrame:
    """Accept or refuse label repairs ``(id, iri, label, predicate, language)``.

    One per entity, only for reported missing labels, none recorded yet.
    """
    o = options or Options()
    reported = findings.filter(F.col("rule") == "label.missing").select("iri").distinct().withColumn("_found", F.lit(True))
    labelled = quads.filter(F.col("p").isin(o.labels)).select(F.col("s").alias("iri")).distinct().withColumn("_has", F.lit(True))
    first = repairs.groupBy("iri").agg(F.min("id").alias("_first"))
    rows = repairs.join(first, "iri").join(reported, "iri", "left").join(labelled, "iri", "left")
    reason = (F.when((F.trim("label") == "") | ~F.col("predicate").isin(o.labels), "invalid")
              .when(~F.coalesce("language", F.lit("")).rlike(r"^([A-Za-z]+(-[A-Za-z0-9]+)*)?$"), "invalid")
              .when(F.col("id") != F.col("_first"), "duplicate")
              .when(F.col("_found").isNull(), "not reported").when(F.col("_has"), "already labelled"))
    return rows.select(*repairs.columns, reason.alias("refused"))


def write_findings(findings: DataFrame, path: str, status: str = "complete", fmt: str = "csv") -> None:
    """Export findings with the scan status on every row."""
    rows = findings.withColumn("status", F.lit(status))
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
