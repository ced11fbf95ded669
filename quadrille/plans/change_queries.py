"""Registered queries: edits, merges, change capture, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrille import model as m
from quadrille.operators import edits as ed, entities as en, merge as mg, patterns as pt, taxonomy as tax
from quadrille.operators import paths as pa
from quadrille.plans.aggregate_queries import LABEL_PICK
from quadrille.plans.common import BALANCE, COMMENT, EX, LABEL, NATION, SEE_ALSO, SUBCLASS, TYPE, count_by
from quadrille.plans.registry import query
from quadrille.session import cut, shared_folder
from quadrille.sources import exports as xp, files as fl, jsondata as js, ntriples as nt, validate as va
from quadrille.streaming import changes as ch

PART = f"'{EX}part/' || "


def part_iri(c="p_partkey"):
    return F.concat(F.lit(EX + "part/"), F.col(c).cast("string"))


def folder(src) -> str:
    return f"{shared_folder(src.spark)}/t-{uuid.uuid4().hex}"


def _tree(src):
    q = src.loaded("catalog")
    edges = cut(pa.edges_of(q, SUBCLASS).distinct())
    return q, edges, pa.graph_nodes(edges).withColumnRenamed("node", "iri")


# -- edits ------------------------------------------------------------------

@query("M1", "renamed_iris", data="customers geo", sql=f"""
    SELECT DISTINCT s, p, CASE WHEN o_kind <> 'literal' AND starts_with(o, '{EX}nation/') THEN replace(o, '/nation/', '/country/') ELSE o END AS o
    FROM (SELECT CASE WHEN starts_with(s, '{EX}nation/') THEN replace(s, '/nation/', '/country/') ELSE s END AS s, p, o, o_kind, o_lang FROM quads)""")
def renamed_iris(src):
    n = src.table("nation").select(F.col("n_nationkey").cast("string").alias("k"))
    mapping = n.select(F.concat(F.lit(EX + "nation/"), "k").alias("old"), F.concat(F.lit(EX + "country/"), "k").alias("new"))
    return ed.rename_iris(src.quads("customers", "geo"), mapping).select("s", "p", "o").distinct()


@query("M1", "replaced_subjects", data="customers", sql=f"""
    SELECT s, p, o FROM quads WHERE s NOT IN (SELECT '{EX}customer/' || c_custkey FROM customer WHERE c_custkey % 5 = 0)
    UNION ALL SELECT '{EX}customer/' || c_custkey, '{LABEL}', upper(c_name) FROM customer WHERE c_custkey % 5 = 0""")
def replaced_subjects(src):
    c = src.table("customer").filter("c_custkey % 5 = 0")
    new = m.literal_quads(c, F.concat(F.lit(EX + "customer/"), F.col("c_custkey").cast("string")), F.lit(LABEL), F.upper("c_name"))
    return ed.replace_subjects(src.quads("customers"), new).select("s", "p", "o")


@query("M2", "moved_classes", data="catalog", sql=f"""
    SELECT s, o FROM (SELECT s, o FROM quads WHERE p = '{SUBCLASS}' AND NOT (s IN (SELECT {PART}p_partkey FROM part WHERE p_size = 5 AND p_partkey > 0)
      AND o = '{EX}part/' || (cast(regexp_extract(s, '[0-9]+$') AS bigint) // 6)) UNION SELECT {PART}p_partkey, '{EX}type/PROMO' FROM part WHERE p_size = 5 AND p_partkey > 0)
    WHERE o <> '{m.THING}'""")
def moved_classes(src):
    q, edges, nodes = _tree(src)
    moves = src.table("part").filter("p_size = 5 and p_partkey > 0").select(
        part_iri().alias("iri"), F.concat(F.lit(EX + "part/"), F.floor(F.col("p_partkey") / 6).cast("string")).alias("from_parent"),
        F.lit(EX + "type/PROMO").alias("parent"))
    # nested members travel with their moved ancestor: the tops move first,
    # what lies below them in the next rounds, one for each level of nesting
    out, rest = q, cut(moves)
    while not rest.isEmpty():
        tops = cut(tax.branch_roots(edges, rest.select("iri")))
        out = cut(ed.move_classes(out, edges, nodes, rest.join(tops, "iri", "left_semi"))[0])
        rest = cut(rest.join(tops, "iri", "left_anti"))
    return out.filter(F.col("p") == SUBCLASS).select("s", "o")


@query("M3", "deleted_classes", data="catalog", sql=f"""
    WITH gone AS MATERIALIZED (SELECT {PART}p_partkey AS iri FROM part WHERE p_size = 9),
    e AS MATERIALIZED (SELECT DISTINCT s, o FROM quads WHERE p = '{SUBCLASS}'),
    c AS (SELECT s, o AS up FROM e WHERE s NOT IN (FROM gone) UNION SELECT c.s, e.o FROM c JOIN e ON e.s = c.up WHERE c.up IN (FROM gone))
    SELECT DISTINCT s, up AS o FROM c WHERE up NOT IN (FROM gone) AND s <> up AND up <> '{m.THING}'""")
def deleted_classes(src):
    gone = src.table("part").filter("p_size = 9").select(part_iri().alias("iri"))
    return ed.delete_classes(src.loaded("catalog"), gone).filter(F.col("p") == SUBCLASS).select("s", "o")


@query("M4", "created_hierarchy", sql=f"""
    SELECT s, p, count(*) AS n FROM (
      SELECT 'new' AS s, '{TYPE}' AS p FROM part WHERE p_size % 11 <> 0 UNION ALL SELECT 'new', '{LABEL}' FROM part WHERE p_size % 11 <> 0
      UNION ALL SELECT 'new', '{SUBCLASS}' FROM part WHERE p_size % 11 <> 0 UNION ALL SELECT 'refused', 'x' FROM part WHERE p_size % 11 = 0) GROUP BY ALL""")
def created_hierarchy(src):
    part = src.table("part")
    rows = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("label"),
                       F.when(F.col("p_size") % 11 == 0, F.col("p_partkey")).alias("parent_id"),
                       F.lit(None).cast("string").alias("parent_iri"))
    known = F.col("s").startswith(EX + "customer/")
    out, refused = ed.create_classes(src.quads("customers"), rows, EX)
    return count_by(out.filter(~known).select(F.lit("new").alias("s"), "p").unionAll(refused.select(F.lit("refused"), F.lit("x"))), "s", "p")


@query("M4", "inserted_above", data="catalog", sql=f"""
    WITH x AS (SELECT {PART}p_partkey AS child, '{EX}above/' || p_partkey AS iri FROM part WHERE p_size = 13)
    SELECT s, o FROM quads WHERE p = '{SUBCLASS}' AND s NOT IN (SELECT child FROM x) UNION SELECT child, iri FROM x
    UNION SELECT x.iri, q.o FROM x JOIN quads q ON q.s = x.child AND q.p = '{SUBCLASS}'""")
def inserted_above(src):
    rows = src.table("part").filter("p_size = 13").select(part_iri().alias("child"), F.concat(F.lit(EX + "above/"), F.col("p_partkey").cast("string")).alias("iri"))
    return ed.insert_above(src.loaded("catalog"), rows).filter(F.col("p") == SUBCLASS).select("s", "o")


@query("M5", "created_entities", sql=f"""
    SELECT count(*) AS n, count(*) FILTER (WHERE p_size % 2 = 0) AS synonyms, count(*) FILTER (WHERE p_size < 10) AS comments FROM part""")
def created_entities(src):
    rows = src.table("part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " and cap").otherwise(" cap")).alias("label"),
        F.lit("Individual").alias("kind"), F.lit(EX + "Kit").alias("type"), F.when(F.col("p_size") < 10, F.col("p_type")).alias("comment"))
    out = ed.create_entities(src.quads("customers"), rows, EX).filter(~F.col("s").startswith(EX + "customer/"))
    return out.agg(F.count_if(F.col("p") == LABEL).alias("n"), F.count_if(F.col("p") == SEE_ALSO).alias("synonyms"), F.count_if(F.col("p") == COMMENT).alias("comments"))


@query("M6", "edited_edges", data="customers geo", sql=f"""
    SELECT s, CASE WHEN cast(regexp_extract(s, '[0-9]+$') AS bigint) % 4 = 1 THEN '{EX}nation/0' ELSE o END AS o FROM quads
    WHERE p = '{NATION}' AND cast(regexp_extract(s, '[0-9]+$') AS bigint) % 4 <> 0""")
def edited_edges(src):
    q = src.loaded("customers", "geo")
    k = F.col("c_custkey") % 4
    own = F.concat(F.lit(EX + "nation/"), F.col("c_nationkey").cast("string"))
    edits = src.table("customer").filter(k < 3).select(
        F.col("c_custkey").alias("id"), F.when(k == 0, "remove").when(k == 1, "edit").otherwise("add").alias("op"),
        F.concat(F.lit(EX + "customer/"), F.col("c_custkey").cast("string")).alias("s"), F.lit(NATION).alias("p"),
        own.alias("o"), F.lit(EX + "nation/0").alias("new_o"))
    return ed.edit_edges(q, edits)[0].filter(F.col("p") == NATION).select("s", "o")


@query("M7", "defined_intersections", sql=f"""
    SELECT {PART}p_partkey AS owner, b.member FROM part, (SELECT 0 AS k UNION ALL SELECT 1) t,
      LATERAL (SELECT CASE t.k WHEN 0 THEN '{EX}brand/' || substr(p_brand, 7) ELSE '{EX}type/' || p_type END AS member) b WHERE p_size % 5 = 0""")
def defined_intersections(src):
    part = src.table("part").filter("p_size % 5 = 0")
    members = F.array(F.concat(F.lit(EX + "brand/"), F.expr("substr(p_brand, 7)")), F.concat(F.lit(EX + "type/"), "p_type"))
    rows = part.select(part_iri().alias("iri"), F.posexplode(members).alias("position", "member"))
    # an earlier, longer definition that the second call replaces
    longer = part.select(part_iri().alias("iri"), F.posexplode(F.array_append(members, F.lit(EX + "brand/0"))).alias("position", "member"))
    q = cut(ed.set_intersection(cut(ed.set_intersection(src.quads("customers"), longer)), rows))
    return en.intersection_edges(q, en.intersections(q)).select("owner", "member")


@query("M8", "added_parents", data="catalog", sql=f"""
    SELECT count(*) AS n FROM (SELECT s, o FROM quads WHERE p = '{SUBCLASS}' AND o <> '{m.THING}' UNION SELECT {PART}p_partkey, '{EX}type/' || p_type FROM part)""")
def added_parents(src):
    q, edges, nodes = _tree(src)
    rows = src.table("part").select(part_iri().alias("iri"), F.concat(F.lit(EX + "type/"), "p_type").alias("parent"))
    out, _ = ed.add_parents(q, edges, nodes, rows)
    return out.filter(F.col("p") == SUBCLASS).agg(F.count(F.lit(1)).alias("n"))


@query("M9", "added_literals", data="catalog", sql=f"""
    SELECT s, o FROM quads WHERE p = '{SEE_ALSO}' AND o_kind = 'literal' UNION SELECT {PART}p_partkey, p_brand || ' ' || p_name FROM part""")
def added_literals(src):
    rows = src.table("part").select(part_iri().alias("iri"), F.lit(SEE_ALSO).alias("predicate"), F.concat_ws(" ", "p_brand", "p_name").alias("value"),
                                    F.lit(None).cast("string").alias("lang"))
    return ed.add_literals(src.loaded("catalog"), rows).filter((F.col("p") == SEE_ALSO) & m.is_literal()).select("s", "o")


@query("M10", "renamed_labels", data="catalog", sql=f"""
    SELECT q.s, q.o_lang AS lang, CASE WHEN l.s IS NOT NULL AND q.s LIKE '%/part/%' THEN 'New ' || q.s ELSE q.o END AS o FROM quads q
    LEFT JOIN {LABEL_PICK} l ON l.s = q.s AND l.o = q.o AND coalesce(l.o_lang, '') = coalesce(q.o_lang, '') WHERE q.p = '{LABEL}'""")
def renamed_labels(src):
    rows = src.table("part").select(part_iri().alias("iri"), F.concat(F.lit("New "), part_iri()).alias("label"))
    return ed.rename_labels(src.loaded("catalog"), rows).filter(F.col("p") == LABEL).select("s", F.col("o_lang").alias("lang"), "o")


@query("M11", "edited_cells", sql="""
    SELECT p_partkey, CASE WHEN p_retailprice - 800 <= 500 AND p_size % 6 BETWEEN 1 AND 5 THEN p_retailprice - 800 ELSE p_retailprice END AS price,
      CASE WHEN p_retailprice - 800 <= 500 AND p_size % 6 BETWEEN 1 AND 5 THEN p_size % 6 ELSE 0 END AS rating FROM part""")
def edited_cells(src):
    part = src.table("part")
    base = part.select("p_partkey", F.col("p_retailprice").alias("price"), F.lit(0).alias("rating"))
    edits = part.select("p_partkey", (F.col("p_retailprice") - 800).cast("string").alias("price"), (F.col("p_size") % 6).cast("string").alias("rating"))
    return ed.edit_cells(base, edits, "p_partkey")[0]


@query("M12", "three_way_merge", sql=f"""
    WITH c AS (SELECT '{EX}conv/' || conv_id || '/' || turn AS s, (conv_id + turn) % 5 AS k FROM conversations)
    SELECT s, CASE k WHEN 0 THEN 'base' WHEN 1 THEN 'local' WHEN 2 THEN 'current' WHEN 3 THEN 'current' ELSE 'both' END AS o, k = 3 AS conflict FROM c WHERE k <> 4
    UNION ALL SELECT s, 'both', false FROM c WHERE k = 4""")
def three_way_merge(src):
    t = src.table("conversations")
    k = (F.col("conv_id") + F.col("turn")) % 5
    s = F.concat_ws("/", F.lit(EX + "conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    p = F.lit(EX + "state")

    def version(*cases):
        text = F.lit("base")
        for n, v in cases:
            text = F.when(k == n, v).otherwise(text)
        return m.literal_quads(t, s, p, text)

    merged, clash = mg.merge3(version(), version((1, "local"), (3, "local"), (4, "both")), version((2, "current"), (3, "current"), (4, "both")))
    return merged.select("s", "o").join(clash.select("s", F.lit(True).alias("conflict")), "s", "left").fillna(False, ["conflict"])


@query("M13", "merged_comments", sql=f"""
    SELECT '{EX}conv/' || conv_id || '/' || turn AS s, 'A ' || text || ' B' AS o FROM conversations""")
def merged_comments(src):
    t = src.table("conversations")
    s = F.concat_ws("/", F.lit(EX + "conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))

    def version(text):
        return m.literal_quads(t, s, F.lit(COMMENT), text)

    merged, clash = mg.merge3(version(F.col("text")), version(F.concat(F.lit("A "), "text")), version(F.concat("text", F.lit(" B"))))
    return merged.select("s", "o")


@query("M14", "aligned_blank_nodes", data="definitions", sql="SELECT s, p, o FROM quads")
def aligned_blank_nodes(src):
    base = src.loaded("definitions")
    fresh = [F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:new"), F.expr(f"substr({c}, 3)"))).otherwise(F.col(c)).alias(c) for c in ("s", "o")]
    local = base.select(fresh[0], "p", fresh[1], *[c for c in m.QUAD_COLS if c not in ("s", "p", "o")])
    roots = base.filter(~m.is_bnode(F.col("s"))).select(F.col("s").alias("iri")).distinct()
    out = mg.align_bnodes(base, local, roots)
    lone = out.filter(F.col("s").startswith("_:new"))   # structures no root leads to keep their new names
    back = lone.select(F.concat(F.lit("_:"), F.expr("substr(s, 6)")).alias("s"), "p", F.when(F.col("o").startswith("_:new"), F.concat(F.lit("_:"), F.expr("substr(o, 6)"))).otherwise(F.col("o")).alias("o"))
    return out.filter(~F.col("s").startswith("_:new")).select("s", "p", "o").unionAll(back)


@query("M15 I4 I5", "replaced_dataset", data="customers", sql="SELECT s, p, o FROM quads")
def replaced_dataset(src):
    q = src.quads("customers")
    written, refused = ed.replace_quads(q.unionAll(q), folder(src))
    return written.select("s", "p", "o")


@query("M16", "checked_creations", data="catalog", sql="""
    SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size % 4 = 0 THEN 'own target' END, CASE WHEN p_size % 4 = 1 THEN 'target kind' END,
      CASE WHEN p_size % 3 = 0 THEN 'predicate' END, CASE WHEN p_size % 3 = 1 THEN 'value must be an IRI' END) AS errors FROM part""")
def checked_creations(src):
    a, b = F.col("p_size") % 4, F.col("p_size") % 3
    rows = src.table("part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit(EX + "new/"), F.col("p_partkey").cast("string")).alias("iri"), F.lit("Class").alias("kind"),
        F.when(a == 0, F.concat(F.lit(EX + "new/"), F.col("p_partkey").cast("string"))).when(a == 1, F.concat(F.lit(EX + "prop/"), "p_type")).otherwise(F.concat(F.lit(EX + "type/"), "p_type")).alias("target"),
        F.when(b == 0, LABEL).when(b == 1, F.concat(F.lit(EX + "prop/"), "p_type")).otherwise(EX + "note").alias("predicate"), F.col("p_name").alias("value"))
    return ed.check_creations(rows, en.project_kinds(src.loaded("catalog"))).select("id", F.array_join("errors", ",").alias("errors"))


@query("M17", "replaced_subject_block", data="definitions", sql=f"""
    WITH me AS (SELECT min(s) AS s FROM quads WHERE p = '{m.EQUIVALENT}')
    SELECT s, p, o FROM quads UNION ALL SELECT s, '{COMMENT}', 'edited' FROM me""")
def replaced_subject_block(src):
    q = src.loaded("definitions")
    iri = q.filter(F.col("p") == m.EQUIVALENT).agg(F.min("s")).first()[0]
    own = cut(pa.concise_description(q, src.spark.range(1).select(F.lit(iri).alias("iri"))).select(*m.QUAD_COLS))
    note = m.literal_quads(src.spark.range(1), F.lit(iri), F.lit(COMMENT), F.lit("edited"))
    return mg.replace_subject_block(q, iri, own, own.unionByName(note))[0].select("s", "p", "o")


# -- change capture ---------------------------------------------------------

def _new_customers(src):
    """Customers after a revision: some renamed, some gone, some blank."""
    q = src.loaded("customers")
    k = F.substring_index("s", "/", -1).try_cast("long") % 10
    out = q.filter(k != 3).withColumn("o", F.when((k == 4) & (F.col("p") == LABEL), F.upper("o")).otherwise(F.col("o")))
    link = out.filter((k == 5) & (F.col("p") == LABEL)).select(
        "s", F.lit(SEE_ALSO).alias("p"), F.lit("_:note").alias("o"), F.lit("bnode").alias("o_kind"), "o_datatype", "o_lang", "g", "pos")
    return q, out.unionByName(link)


@query("D1", "subject_differences", sql=f"""
    SELECT '{EX}customer/' || c_custkey AS s, CASE c_custkey % 10 WHEN 3 THEN 'remove' ELSE 'replace' END AS op, c_custkey % 10 = 5 AS reload
    FROM customer WHERE c_custkey % 10 IN (3, 4, 5)""")
def subject_differences(src):
    return ch.subject_diff(*_new_customers(src))


@query("D2", "entity_change_feed", sql="""
    SELECT c_custkey AS iri, CASE c_custkey % 10 WHEN 3 THEN 'removed' WHEN 4 THEN 'changed' ELSE 'added' END AS change,
      CASE WHEN c_custkey % 10 = 7 THEN c_custkey END AS position FROM customer WHERE c_custkey % 10 IN (3, 4, 7)""")
def entity_change_feed(src):
    c = src.table("customer").select(F.col("c_custkey").alias("iri"), F.col("c_custkey").alias("position"), "c_name")
    new = c.filter("iri % 10 <> 3").withColumn("c_name", F.when(F.col("iri") % 10 == 4, F.upper("c_name")).otherwise(F.col("c_name")))
    return ch.entity_changes(c.filter("iri % 10 <> 7"), new)


@query("D3", "entity_catalogue", data="catalog", sql=f"""
    WITH e AS MATERIALIZED (SELECT DISTINCT s AS src, o AS dst FROM quads WHERE p = '{SUBCLASS}'), u AS (SELECT src, dst FROM e UNION SELECT u.src, e.dst FROM u JOIN e ON u.dst = e.src),
    ent AS (SELECT s AS iri FROM quads UNION SELECT o FROM quads WHERE o_kind <> 'literal')
    SELECT ent.iri, coalesce(i.n, 0) AS instances, coalesce(d.n, 0) AS descendants FROM ent
    LEFT JOIN (SELECT o, count(DISTINCT s) AS n FROM quads WHERE p = '{TYPE}' GROUP BY o) i ON i.o = ent.iri
    LEFT JOIN (SELECT dst, count(*) AS n FROM u GROUP BY dst) d ON d.dst = ent.iri""")
def entity_catalogue(src):
    q = src.loaded("catalog")
    out = ch.entity_catalog(en.base_kinds(q), pt.instance_counts(q), q.groupBy("p").agg(F.count(F.lit(1)).alias("uses")),
                            tax.descendant_counts(pa.edges_of(q, SUBCLASS)))
    return out.select("iri", "instances", "descendants")


def _deltas(src):
    """Event stream as statement deltas: an error removes, others add."""
    e = src.table("events")
    s = F.concat(F.lit(EX + "user/"), F.col("user_id").cast("string"))
    value = F.get_json_object("props", "$.k")
    q = m.literal_quads(e.withColumn("_v", value), s, F.lit(EX + "k"), F.col("_v"))
    return e.select(s.alias("s"), F.lit(EX + "k").alias("p"), value.alias("o"), F.lit("literal").alias("o_kind"),
                    F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("g"),
                    F.lit(0).cast("long").alias("pos"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"),
                    F.col("event_id").alias("seq")), q


_LAST = f"""SELECT s, o FROM (SELECT '{EX}user/' || user_id AS s, cast(json_extract_string(props, '$.k') AS varchar) AS o, event_type, row_number() OVER (
    PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'"""


@query("D4", "applied_deltas", sql=_LAST)
def applied_deltas(src):
    deltas, q = _deltas(src)
    return ch.apply_deltas(q.dropDuplicates(m.STATEMENT), deltas).select("s", "o")


@query("D4", "streamed_deltas", sql=_LAST)
def streamed_deltas(src):
    deltas, q = _deltas(src)
    base = folder(src)
    deltas.repartitionByRange(4, "seq").write.parquet(f"{base}/in")
    # the table starts with every statement ever seen; the replay settles it
    ch.write_table(q.dropDuplicates(m.STATEMENT), f"{base}/table")
    stream = src.spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    ch.stream_deltas(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return ch.read_table(src.spark, f"{base}/table").select("s", "o")


@query("D5", "context_drift", sql=f"""
    SELECT {PART}p_partkey AS iri, CASE WHEN p_size % 5 = 0 THEN 'label' WHEN p_size % 3 = 0 THEN 'comment' ELSE 'parents' END AS reason
    FROM part WHERE p_size % 5 = 0 OR p_size % 3 = 0 OR p_size % 7 = 0""")
def context_drift(src):
    part = src.table("part")

    def version(changed: bool):
        def v(cond, col):
            return F.when(cond, F.concat(col, F.lit("!"))).otherwise(col) if changed else col
        cells = F.array(
            F.struct(F.lit("label").alias("aspect"), v(F.col("p_size") % 5 == 0, F.col("p_name")).alias("value")),
            F.struct(F.lit("comment").alias("aspect"), v(F.col("p_size") % 3 == 0, F.col("p_type")).alias("value")),
            F.struct(F.lit("parents").alias("aspect"), v(F.col("p_size") % 7 == 0, F.col("p_brand")).alias("value")))
        return part.select(part_iri().alias("iri"), F.explode(cells).alias("c")).select("iri", "c.*")

    return ch.context_drift(version(False), version(True))


# -- sources and sinks ------------------------------------------------------

def _texts_as_quads(src):
    """Documents and conversation turns as literals that need escaping."""
    d = src.table("documents")
    return m.literal_quads(d, F.concat(F.lit(EX + "doc/"), F.col("doc_id").cast("string")), F.lit(COMMENT), F.concat(F.lit('"\\\t'), "text"), lang=F.col("lang"))


@query("I1 I8", "ntriples_round_trip", sql=f"""
    SELECT '{EX}doc/' || doc_id AS s, md5('"\\' || chr(9) || text) AS digest, lang FROM documents""")
def ntriples_round_trip(src):
    path = folder(src)
    nt.write_ntriples(_texts_as_quads(src), path)
    back, bad = nt.read_ntriples(src.spark, path)
    return back.select("s", F.md5("o").alias("digest"), F.col("o_lang").alias("lang"))


@query("I2 I6", "nquads_round_trip", data="customer_graphs definitions", sql="""
    SELECT p, count(*) AS n, count(DISTINCT o) AS objects, count(DISTINCT g) AS graphs FROM quads GROUP BY p""")
def nquads_round_trip(src):
    path = folder(src)
    nt.write_nquads(src.quads("customer_graphs", "definitions"), path)
    back, bad = nt.read_nquads(src.spark, f"{path}/*.txt", scoped=False)
    return back.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("objects"), F.countDistinct("g").alias("graphs"))


@query("I2", "quarantined_lines", sql="""
    SELECT count(*) FILTER (WHERE item_id % 2 = 0) AS good, count(*) FILTER (WHERE item_id % 2 = 1) AS bad FROM benchmark""")
def quarantined_lines(src):
    b = src.table("benchmark")
    fine = F.concat(F.lit(f"<{EX}b> <{EX}p> \""), nt.escape_literal(F.col("text")), F.lit('"@en . # note'))
    lines = b.select(F.when(F.col("item_id") % 2 == 0, fine).otherwise(F.concat(F.lit("<< broken "), F.regexp_replace("text", "\n", " "))).alias("value"))
    good, bad = nt.parse_lines(lines)
    return good.agg(F.count(F.lit(1)).alias("good")).withColumn("bad", bad.agg(F.count(F.lit(1))).scalar())


@query("I3", "detected_formats", sql="""
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'rdfxml' WHEN 1 THEN 'jsonld' WHEN 2 THEN 'turtle' WHEN 3 THEN 'nquads' ELSE 'rdfxml' END AS format FROM pages""")
def detected_formats(src):
    k = F.col("page_id") % 5
    head = F.when(k == 0, '  <?xml version="1.0"?>').when(k == 1, "[ {").when(k == 2, "@prefix ex: <urn:x> .").otherwise("plain ")
    ext = F.when(k == 2, "owl").when(k == 3, "nq").when(k == 4, "owl").otherwise("txt")
    files = src.table("pages").select("page_id", F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"),
                                      F.encode(F.concat(head, "html"), "UTF-8").alias("content"))
    return fl.detect_format(files).select("page_id", "format")


@query("I4", "refused_statements", sql="""
    SELECT reason, count(*) AS n FROM (SELECT CASE page_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'language' WHEN 2 THEN 'subject' WHEN 3 THEN 'datatype' END AS reason FROM pages) WHERE reason IS NOT NULL GROUP BY reason""")
def refused_statements(src):
    k = F.col("page_id") % 5
    q = src.table("pages").select(
        F.when(k == 2, "no scheme").otherwise(F.concat(F.lit(EX), F.col("page_id").cast("string"))).alias("s"), F.lit(LABEL).alias("p"),
        F.when(k == 0, F.concat(F.lit("not an iri "), "url")).otherwise(F.col("html")).alias("o"), F.when(k == 0, "iri").otherwise("literal").alias("o_kind"),
        F.when(k == 3, "no type").alias("o_datatype"), F.when(k == 1, "x_y").alias("o_lang"), F.lit(None).cast("string").alias("g"), F.col("page_id").alias("pos"))
    return count_by(va.split_valid(q)[1], "reason")


@query("I7", "ontology_headers", sql=f"""
    SELECT n_regionkey AS source, '{EX}onto/' || min(n_nationkey) AS iri, '{EX}onto/' || min(n_nationkey) || '#' AS namespace FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def ontology_headers(src):
    n = src.table("customer").join(src.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = m.resource_quads(n, F.concat(F.lit(EX + "onto/"), F.col("n_nationkey").cast("string")), F.lit(TYPE), F.lit(m.OWL + "Ontology"), pos=F.col("n_nationkey"))
    q = q.withColumn("source", (F.substring_index("s", "/", -1).try_cast("long") % 5).cast("int"))
    return fl.ontology_info(q)


@query("I9", "jsonld_nodes", data="customer_graphs", sql=f"""
    SELECT s, count(*) AS n, max(CASE WHEN p = '{LABEL}' THEN o END) AS label FROM quads GROUP BY s""")
def jsonld_nodes(src):
    path = folder(src)
    xp.write_jsonld(src.quads("customer_graphs"), path)
    lines = src.spark.read.text(path)
    node = F.get_json_object("value", "$['@graph'][0]")
    keys = F.json_object_keys(node)
    return lines.select(F.get_json_object(node, "$['@id']").alias("s"), (F.size(keys) - 1).cast("long").alias("n"),
                        F.get_json_object(node, f"$['{LABEL}'][0]['@value']").alias("label"))


@query("I10", "statement_csv", data="customers", sql="""
    SELECT s AS subject, CASE WHEN starts_with(o, '-') THEN '''' || o ELSE o END AS value, CASE o_kind WHEN 'literal' THEN 'Literal' ELSE 'Resource' END AS kind FROM quads""")
def statement_csv(src):
    path = folder(src)
    xp.write_statement_csv(src.quads("customers"), path)
    back = src.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(F.col("Subject").alias("subject"), F.col("Value").alias("value"), F.col("Term kind").alias("kind"))


@query("I11", "entity_report", data="customers", sql=f"""
    SELECT kind, count(*) AS rows, count(DISTINCT iri) AS entities FROM (
      SELECT s AS iri, 'Individual' AS kind FROM quads UNION ALL SELECT DISTINCT o, CASE WHEN o = '{EX}Customer' THEN 'Class' ELSE 'Resource' END FROM quads WHERE o_kind <> 'literal') GROUP BY kind""")
def entity_report(src):
    q = src.loaded("customers")
    path = folder(src)
    xp.write_report(en.project_entities(q, en.project_kinds(q)), q, path)
    return src.spark.read.json(path).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("iri").alias("entities"))


@query("I13 I15", "files_and_provenance", sql="""
    SELECT path, name, image, count(*) AS n FROM (SELECT '/docs/' || source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.txt' END AS path,
      doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.txt' END AS name, doc_id % 3 = 0 AS image, unnest([1, 2]) FROM documents
      UNION ALL SELECT '/docs/' || source, source, false, 1 FROM documents GROUP BY source) GROUP BY ALL""")
def files_and_provenance(src):
    d = src.table("documents")
    path = F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".txt"))
    files = d.select(path.alias("path"), F.concat(F.lit("/docs/"), "source").alias("parent"), F.lit(False).alias("directory"), F.lit("2024-01-01T00:00:00Z").alias("observed"),
                     F.lit(False).alias("reparse"), F.to_json(F.struct("lang", "n_chars")).alias("metadata"), F.array(F.lit("unread")).alias("issues"))
    q = cut(fl.files_to_prov(files, "scan"))
    return fl.linked_files(q).groupBy("path", "name", "image").agg(F.count(F.lit(1)).alias("n"))


@query("I14", "flattened_event_json", sql="""
    SELECT event_id, 'a/b/0' AS path, json_extract_string(props, '$.k') AS value, 'http://www.w3.org/2001/XMLSchema#integer' AS datatype FROM events
    UNION ALL SELECT event_id, 'a/b/1/type', event_type, NULL FROM events UNION ALL SELECT event_id, 'ok', CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END, 'http://www.w3.org/2001/XMLSchema#boolean' FROM events""")
def flattened_event_json(src):
    e = src.table("events")
    text = F.concat(F.lit('{"a": {"b": ['), F.get_json_object("props", "$.k"), F.lit(', {"type": "'), "event_type", F.lit('"}]}, "ok": '),
                    F.when(F.col("event_type") == "error", "false").otherwise("true"), F.lit("}"))
    return js.flatten_json(e.select("event_id", text.alias("j")), "event_id", "j")


@query("I16", "run_provenance", sql="""
    SELECT p, count(*) AS n FROM (SELECT source, unnest(['type', 'label', 'agent', 'start', 'root', 'end', 'status', 'entries', 'issues']) AS p FROM documents GROUP BY source) GROUP BY p""")
def run_provenance(src):
    runs = src.table("documents").groupBy(F.col("source").alias("id")).agg(
        F.first("source").alias("root"), F.lit("2024-01-01T00:00:00Z").alias("started"), F.lit("2024-01-02T00:00:00Z").alias("ended"),
        F.lit("complete").alias("status"), F.count(F.lit(1)).alias("entries"), F.count_if(F.col("n_chars") > 10000).alias("issues"))
    q = fl.run_to_prov(runs).filter(F.col("s").startswith("urn:uuid:"))
    short = {TYPE: "type", LABEL: "label", m.PROV + "wasAssociatedWith": "agent", m.PROV + "startedAtTime": "start", fl.FS + "selectedRoot": "root",
             m.PROV + "endedAtTime": "end", fl.FS + "completionStatus": "status", fl.FS + "entriesObserved": "entries", fl.FS + "coverageIssues": "issues"}
    return count_by(q.select(F.create_map(*[F.lit(x) for kv in short.items() for x in kv])[F.col("p")].alias("p")), "p")


def _responses(src):
    p = src.table("pages")
    title = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    item = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"wikibase_item": "Q'), (F.col("page_id") + 1).cast("string"), F.lit('"}'))).otherwise('{"disambiguation": ""}')
    return p.select("page_id", F.concat(
        F.lit('{"query": {"pages": [{"pageid": '), (F.col("page_id") + 1).cast("string"), F.lit(', "index": 1, "title": "'), title, F.lit('", "pageprops": '), item,
        F.lit('}], "redirects": [{"from": "B '), F.col("page_id").cast("string"), F.lit('", "to": "'), title, F.lit('"}, {"from": "C '), F.col("page_id").cast("string"),
        F.lit('", "to": "B '), F.col("page_id").cast("string"), F.lit('"}]}}')).alias("json"))


@query("I17", "parsed_candidates", sql="""
    SELECT page_id, cast(page_id + 1 AS varchar) AS id, 'Page ' || page_id AS label, 'http://dbpedia.org/resource/Page_' || page_id AS iri,
      CASE WHEN page_id % 2 = 0 THEN 'http://www.wikidata.org/entity/Q' || (page_id + 1) END AS wikidata_iri, page_id % 2 = 1 AS disambiguation FROM pages""")
def parsed_candidates(src):
    return js.parse_candidates(_responses(src), "page_id", "json").select("page_id", "id", "label", "iri", "wikidata_iri", "disambiguation")


@query("I17", "candidate_names", sql="""
    SELECT page_id, cast(page_id + 1 AS varchar) AS id, unnest(['Page ' || page_id, 'B ' || page_id, 'C ' || page_id]) AS name FROM pages""")
def candidate_names(src):
    return js.candidate_names(_responses(src), "page_id", "json")


@query("S8", "result_csv", data="customers", sql=f"""
    SELECT 'c,n,b' || chr(13) AS line UNION ALL SELECT a.s || ',' || a.o || ',' || b.o || chr(13) FROM (SELECT s, o FROM quads WHERE p = '{NATION}') a
    JOIN (SELECT s, o FROM quads WHERE p = '{BALANCE}') b ON a.s = b.s""")
def result_csv(src):
    path = folder(src)
    xp.write_result_csv(pt.bgp(src.quads("customers"), [("?c", NATION, "?n"), ("?c", BALANCE, "?b")]), path)
    return src.spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))
