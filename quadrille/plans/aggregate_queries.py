"""Registered queries: aggregates, censuses, rankings, ordering, sets, updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille import model as m
from quadrille.functions import terms as t
from quadrille.operators import aggregates as ag, entities as en, ordering as od, patterns as pt, updates as up
from quadrille.plans.common import (BALANCE, BUYER, CLASS, DATE, EX, LABEL, NATION, PRIORITY, REF, SEE_ALSO, SEGMENT,
                                    STATUS, SUBCLASS, TOTAL, TYPE, XSD, lex)
from quadrille.plans.registry import query


def _q(p: str) -> str:
    return f"(SELECT s, o FROM quads WHERE p = '{p}')"


DEC = "cast({} AS decimal(18,2))"
LABEL_PICK = f"""(SELECT s, o, o_lang FROM (SELECT s, o, o_lang, row_number() OVER (PARTITION BY s ORDER BY
  CASE WHEN coalesce(o_lang, '') = '' THEN 0 WHEN regexp_matches(o_lang, '^[eE][nN](-|$)') THEN 1 ELSE 2 END, pos) AS k
  FROM quads WHERE p = '{LABEL}' AND o_kind = 'literal') WHERE k = 1)"""


# -- aggregates -------------------------------------------------------------

@query("A1 A2 A4 A5 A6", "order_totals_by_status", data="orders", sql=f"""
    SELECT a.o AS status, count(*) AS n, sum(cast(b.o AS decimal(18,2))) AS total,
      cast(avg(cast(b.o AS decimal(18,2))) AS double) AS mean,
      cast(min(cast(b.o AS decimal(18,2))) AS varchar) AS low, cast(max(cast(b.o AS decimal(18,2))) AS varchar) AS high
    FROM {_q(STATUS)} a JOIN {_q(TOTAL)} b ON a.s = b.s GROUP BY a.o""")
def order_totals_by_status(src):
    rows = pt.bgp(src.quads("orders"), [("?x", STATUS, "?status"), ("?x", TOTAL, "?v")])
    v = F.col("v")
    out = ag.group(rows, ["status"], n=ag.count(), total=ag.sum_(v), mean=ag.avg_(v), low=ag.min_(v), high=ag.max_(v))
    return out.select(F.col("status.value").alias("status"), F.col("n.value").cast("long").alias("n"),
                      F.col("total.value").cast("decimal(38,2)").alias("total"),
                      F.round(F.col("mean.value").cast("double"), 6).alias("mean"),
                      F.col("low.value").alias("low"), F.col("high.value").alias("high"))


@query("A1", "empty_group", data="orders", sql="SELECT 0 AS n, 0 AS total, 0 AS mean, 'unbound' AS low")
def empty_group(src):
    rows = pt.match(src.quads("orders"), "?x", EX + "absent", "?v")
    v = F.col("v")
    out = ag.group(rows, [], n=ag.count(), total=ag.sum_(v), mean=ag.avg_(v), low=ag.min_(v))
    return out.select(*[F.col(f"{c}.value").cast("long").alias(c) for c in ("n", "total", "mean")],
                      F.coalesce("low.value", F.lit("unbound")).alias("low"))


@query("A3", "distinct_buyers_per_status", data="orders", sql=f"""
    SELECT a.o AS status, count(DISTINCT b.o) AS buyers, count(DISTINCT (b.o, c.o)) AS pairs
    FROM {_q(STATUS)} a JOIN {_q(BUYER)} b ON a.s = b.s JOIN {_q(PRIORITY)} c ON a.s = c.s GROUP BY a.o""")
def distinct_buyers_per_status(src):
    rows = pt.bgp(src.quads("orders"), [("?x", STATUS, "?status"), ("?x", BUYER, "?c"), ("?x", PRIORITY, "?pr")])
    out = ag.group(rows, ["status"], buyers=ag.count_distinct(F.col("c")), pairs=ag.count_distinct(F.col("c"), F.col("pr")))
    return out.select(F.col("status.value").alias("status"), F.col("buyers.value").cast("long").alias("buyers"),
                      F.col("pairs.value").cast("long").alias("pairs"))


@query("A4 A5", "sum_with_error_member", data="customers", sql=f"""
    SELECT o AS nation, sum(v) AS clean, cast(NULL AS varchar) AS mixed, sum(DISTINCT v) AS once
    FROM (SELECT a.o, cast(b.o AS decimal(18,2)) AS v FROM {_q(NATION)} a JOIN {_q(BALANCE)} b ON a.s = b.s) GROUP BY o""")
def sum_with_error_member(src):
    q = src.quads("customers")
    rows = pt.bgp(q, [("?c", NATION, "?n"), ("?c", BALANCE, "?v"), ("?c", SEGMENT, "?seg")])
    mixed = F.when(t.term_cmp(F.col("v"), ">", t.literal("0", t.INTEGER)), F.col("v")).otherwise(F.col("seg"))
    rows = pt.bind(rows, "mix", F.when(F.col("seg.value") == "BUILDING", F.col("seg")).otherwise(mixed))
    out = ag.group(rows, ["n"], clean=ag.sum_(F.col("v")), mixed=ag.sum_(F.col("seg")), once=ag.sum_(F.col("v"), distinct=True))
    return out.select(F.col("n.value").alias("nation"), F.col("clean.value").cast("decimal(38,2)").alias("clean"),
                      F.col("mixed.value").alias("mixed"), F.col("once.value").cast("decimal(38,2)").alias("once"))


@query("A6 A7", "first_and_last_terms", data="customers", sql=f"""
    SELECT a.o AS nation, min(b.o) AS low, max(b.o) AS high, min(b.o) AS some
    FROM {_q(NATION)} a JOIN {_q(LABEL)} b ON a.s = b.s GROUP BY a.o""")
def first_and_last_terms(src):
    rows = pt.bgp(src.quads("customers"), [("?c", NATION, "?n"), ("?c", LABEL, "?l")])
    out = ag.group(rows, ["n"], low=ag.min_(F.col("l")), high=ag.max_(F.col("l")), some=ag.sample_(F.col("l")))
    return lex(out.withColumnRenamed("n", "nation"))


@query("A8", "segments_of_nation", data="customers", sql=f"""
    SELECT a.o AS nation, string_agg(DISTINCT b.o, '|' ORDER BY b.o) AS segments, count(*) AS n
    FROM {_q(NATION)} a JOIN {_q(SEGMENT)} b ON a.s = b.s GROUP BY a.o""")
def segments_of_nation(src):
    rows = pt.bgp(src.quads("customers"), [("?c", NATION, "?n"), ("?c", SEGMENT, "?seg")])
    out = ag.group(rows, ["n"], segments=ag.group_concat(F.col("seg"), "|", distinct=True), c=ag.count())
    return out.select(F.col("n.value").alias("nation"), F.col("segments.value").alias("segments"),
                      F.col("c.value").cast("long").alias("n"))


@query("A9", "nations_having_many_customers", data="customers", sql=f"""
    SELECT a.o AS nation, count(*) AS n FROM {_q(NATION)} a JOIN {_q(BALANCE)} b ON a.s = b.s GROUP BY a.o
    HAVING count(*) > 5 AND max(cast(b.o AS decimal(18,2))) > 9000""")
def nations_having_many_customers(src):
    rows = pt.bgp(src.quads("customers"), [("?c", NATION, "?n"), ("?c", BALANCE, "?b")])
    out = ag.group(rows, ["n"], c=ag.count(), top=ag.max_(F.col("b")))
    out = ag.having(out, t.term_cmp(F.col("c"), ">", t.literal("5", t.INTEGER)),
                    t.term_cmp(F.col("top"), ">", t.literal("9000", t.INTEGER)))
    return out.select(F.col("n.value").alias("nation"), F.col("c.value").cast("long").alias("n"))


@query("A10", "result_column_census", data="customers suppliers", sql=f"""
    WITH r AS (SELECT a.s, a.o AS n, b.o AS b FROM {_q(NATION)} a LEFT JOIN {_q(BALANCE)} b ON a.s = b.s)
    SELECT name, rows, fill, dist AS "distinct", CASE WHEN fill = 0 THEN 'empty' WHEN dist = 1 THEN 'constant'
      WHEN fill = rows AND dist = rows THEN 'unique' END AS reason FROM (
      SELECT 'c' AS name, count(*) AS rows, count(s) AS fill, count(DISTINCT s) AS dist FROM r
      UNION ALL SELECT 'n', count(*), count(n), count(DISTINCT n) FROM r
      UNION ALL SELECT 'b', count(*), count(b), count(DISTINCT b) FROM r)""")
def result_column_census(src):
    q = src.quads("customers", "suppliers")
    rows = pt.optional(pt.match(q, "?c", NATION, "?n"), pt.match(q, "?c", BALANCE, "?b"))
    return ag.column_census(rows)


@query("A11", "predicate_usage", data="customers orders suppliers", sql=f"""
    SELECT p, count(*) AS uses FROM quads GROUP BY p""")
def predicate_usage(src):
    return ag.predicate_counts(src.quads("customers", "orders", "suppliers"))


@query("A12", "predicate_options", data="catalog", sql=f"""
    SELECT coalesce(a.p, b.p) AS p, coalesce(a.uses, 0) AS uses FROM
      (SELECT p, count(*) AS uses FROM quads WHERE p <> '{TYPE}' GROUP BY p) a FULL JOIN
      (SELECT s AS p FROM quads WHERE p = '{TYPE}' AND o IN ('{m.OWL}ObjectProperty', '{m.OWL}DatatypeProperty')
       UNION SELECT o FROM quads WHERE p = '{m.SUBPROPERTY}') b ON a.p = b.p""")
def predicate_options(src):
    q = src.loaded("catalog")
    return ag.predicate_options(q, en.base_kinds(q))


@query("A13", "vocabulary_in_use", data="catalog definitions", sql=f"""
    SELECT CASE WHEN starts_with(iri, '{m.RDFS}') THEN 'rdfs' WHEN starts_with(iri, '{m.OWL}') THEN 'owl'
      WHEN starts_with(iri, '{m.SKOS}') THEN 'skos' END AS vocabulary, iri, count(*) AS uses
    FROM (SELECT p AS iri FROM quads UNION ALL SELECT o FROM quads WHERE p = '{TYPE}')
    WHERE starts_with(iri, '{m.RDFS}') OR starts_with(iri, '{m.OWL}') OR starts_with(iri, '{m.SKOS}') GROUP BY ALL""")
def vocabulary_in_use(src):
    return ag.vocabulary_census(src.loaded("catalog", "definitions"))


_KINDS_SQL = f"""
  c AS (SELECT s AS iri FROM quads WHERE p = '{TYPE}' AND o = '{CLASS}' UNION SELECT s FROM quads WHERE p = '{SUBCLASS}'
    UNION SELECT o FROM quads WHERE p = '{SUBCLASS}'),
  pr AS (SELECT s AS iri, CASE WHEN max(o) = '{m.OWL}DatatypeProperty' THEN 'DataProperty' ELSE 'ObjectProperty' END AS kind
    FROM quads WHERE p = '{TYPE}' AND o IN ('{m.OWL}ObjectProperty', '{m.OWL}DatatypeProperty') GROUP BY s
    UNION SELECT DISTINCT o, 'ObjectProperty' FROM quads WHERE p = '{m.SUBPROPERTY}'),
  every AS (SELECT s AS iri FROM quads UNION SELECT o FROM quads WHERE o_kind <> 'literal'),
  kinds AS (SELECT e.iri, CASE WHEN c.iri IS NOT NULL THEN 'Class' ELSE coalesce(pr.kind, 'Resource') END AS kind
    FROM every e LEFT JOIN c ON e.iri = c.iri LEFT JOIN pr ON e.iri = pr.iri)"""


@query("A14 E1", "kind_census", data="catalog", sql=f"WITH {_KINDS_SQL} SELECT kind, count(*) AS entities FROM kinds GROUP BY kind")
def kind_census(src):
    return ag.kind_census(en.project_kinds(src.loaded("catalog")))


@query("A15", "dataset_totals", data="catalog", sql=f"""WITH {_KINDS_SQL}
    SELECT count(*) FILTER (WHERE kind = 'Class') AS classes, count(*) FILTER (WHERE kind LIKE '%Property') AS properties,
      count(*) FILTER (WHERE kind = 'Individual') AS individuals, (SELECT count(*) FROM quads) AS triples FROM kinds""")
def dataset_totals(src):
    q = src.loaded("catalog")
    return ag.totals(q, en.project_kinds(q))


_VALUES_SQL = f"""
  v AS (SELECT DISTINCT q.s, q.p, coalesce(l.o, q.o) AS value FROM quads q LEFT JOIN {LABEL_PICK} l ON q.o_kind <> 'literal' AND l.s = q.o
    WHERE q.s IN (SELECT s FROM quads WHERE p = '{TYPE}' AND o = '{EX}Customer')),
  cells AS (SELECT p, s, count(*) AS n FROM v GROUP BY p, s),
  census AS (SELECT a.p, a.fill, b.dist AS "distinct", a.mx AS max_values, (SELECT count(DISTINCT s) FROM v) AS rows
    FROM (SELECT p, count(*) AS fill, max(n) AS mx FROM cells GROUP BY p) a
    JOIN (SELECT p, count(DISTINCT value) AS dist FROM v GROUP BY p) b ON a.p = b.p)"""


def _individuals(src):
    q = src.quads("customers", "geo")
    labels = ag.preferred_label(q).select("iri", "label")
    return ag.individual_values(q, labels, EX + "Customer")


@query("A16", "customer_column_census", data="customers geo", sql=f"WITH {_VALUES_SQL} SELECT *, false AS identifiers FROM census")
def customer_column_census(src):
    return ag.individual_census(_individuals(src))


@query("A17", "customer_default_columns", data="customers geo", sql=f"""WITH {_VALUES_SQL}
    SELECT p, fill, "distinct" FROM census WHERE p <> '{LABEL}' AND "distinct" > 1 AND fill * 20 >= rows
      AND NOT (fill = rows AND "distinct" = rows) ORDER BY fill DESC, p LIMIT 4""")
def customer_default_columns(src):
    return ag.default_columns(ag.individual_census(_individuals(src)), 4).select("p", "fill", "distinct")


@query("A18", "customer_column_reasons", data="customers geo", sql=f"""WITH {_VALUES_SQL}
    SELECT p, concat_ws(',', CASE WHEN "distinct" = 1 THEN 'one value' WHEN fill = rows AND "distinct" = rows THEN 'unique per row' END,
      CASE WHEN fill * 20 < rows THEN 'sparse' END, CASE WHEN max_values > 1 THEN max_values || ' values deep' END) AS reasons FROM census""")
def customer_column_reasons(src):
    out = ag.column_reasons(ag.individual_census(_individuals(src)))
    return out.select("p", F.array_join("reasons", ",").alias("reasons"))


@query("A19", "supplier_value_grid", data="suppliers geo", sql=f"""
    WITH v AS (SELECT q.s, q.p, coalesce(l.o, q.o) AS value, min(q.pos) AS pos FROM quads q
      LEFT JOIN {LABEL_PICK} l ON q.o_kind <> 'literal' AND l.s = q.o WHERE q.s LIKE '%/supplier/%' GROUP BY ALL),
    c AS (SELECT s, p, string_agg(value, '|' ORDER BY pos) AS cell FROM v GROUP BY s, p)
    SELECT s AS iri, string_agg(p || '=' || cell, ';' ORDER BY p) AS grid FROM c GROUP BY s""")
def supplier_value_grid(src):
    q = src.quads("suppliers", "geo")
    values = ag.individual_values(q, ag.preferred_label(q).select("iri", "label"), EX + "Supplier")
    out = ag.pivot_individuals(values)
    entries = F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return out.select("iri", F.array_join(F.array_sort(entries), ";").alias("grid"))


@query("A20", "grouped_statements", data="catalog", sql=f"""
    SELECT s, p, o, row_number() OVER (PARTITION BY s, p ORDER BY pos, o, o_kind, g) AS item,
      min(pos) OVER (PARTITION BY s, p) AS group_pos, count(*) OVER (PARTITION BY s, p) AS group_size FROM quads""")
def grouped_statements(src):
    return ag.group_statements(src.loaded("catalog")).select("s", "p", "o", "item", "group_pos", "group_size")


# -- rankings ---------------------------------------------------------------

@query("W1", "preferred_labels", data="catalog geo", sql=f"SELECT s AS iri, o AS label, o_lang AS lang FROM {LABEL_PICK}")
def preferred_labels(src):
    return ag.preferred_label(src.quads("catalog", "geo"))


@query("W2", "peer_mean_of_balances", sql="""
    SELECT c_custkey, CASE WHEN count(*) OVER w > 1 THEN round((sum(c_acctbal) OVER w - c_acctbal) / (count(*) OVER w - 1), 6) END AS peer_mean
    FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def peer_mean_of_balances(src):
    out = ag.peer_mean(src.table("customer"), "c_nationkey", "c_acctbal")
    return out.select("c_custkey", F.round("peer_mean", 6).alias("peer_mean"))


@query("W3", "parallel_edge_numbers", data="rings", sql=f"""
    WITH e AS (SELECT DISTINCT s AS src, p AS pred, o AS dst FROM quads WHERE p = '{SUBCLASS}'
      UNION SELECT o, '{SEE_ALSO}', s FROM quads WHERE p = '{SUBCLASS}')
    SELECT src, pred, dst, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY pred, src, dst) AS edge_index,
      count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS edge_count FROM e""")
def parallel_edge_numbers(src):
    e = src.loaded("rings").filter(F.col("p") == SUBCLASS)
    one = e.select(F.col("s").alias("src"), F.col("p").alias("pred"), F.col("o").alias("dst"))
    two = e.select(F.col("o").alias("src"), F.lit(SEE_ALSO).alias("pred"), F.col("s").alias("dst"))
    return ag.parallel_edges(one.unionAll(two).distinct()).select("src", "pred", "dst", "edge_index", "edge_count")


@query("W4", "minted_part_iris", sql=f"""
    WITH stems AS (SELECT p_partkey AS id, '{EX}' || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2)
      || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS stem FROM part),
    used AS (SELECT DISTINCT stem || '2' AS iri FROM stems),
    n AS (SELECT id, stem, row_number() OVER (PARTITION BY stem ORDER BY id) AS i FROM stems)
    SELECT id, CASE WHEN i = 1 THEN stem ELSE stem || (i + 1) END AS iri FROM n""")
def minted_part_iris(src):
    from quadrille.functions.text import identifier_from_label
    names = src.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    taken = names.select(F.concat(F.lit(EX), identifier_from_label(F.col("label")), F.lit("2")).alias("iri")).distinct()
    return ag.mint_iris(names, taken, EX)


@query("W5", "sampled_customers_per_nation", sql="""
    SELECT nation, iri, sample_rank FROM (SELECT cast(c_nationkey AS varchar) AS nation, c_name AS iri, row_number() OVER (
      PARTITION BY c_nationkey ORDER BY md5(cast(c_nationkey AS varchar) || chr(1) || c_name), c_name) AS sample_rank FROM customer) WHERE sample_rank <= 20""")
def sampled_customers_per_nation(src):
    rows = src.table("customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_name").alias("iri"))
    return ag.sample_terms(rows, "nation", "iri", 20)


@query("W6", "primary_parent_paths", data="catalog", sql=f"""
    WITH l AS MATERIALIZED (SELECT s, o FROM {LABEL_PICK}), e AS MATERIALIZED (SELECT s, o FROM (SELECT q.s, q.o, row_number() OVER (
        PARTITION BY q.s ORDER BY lower(coalesce(l.o, '')), coalesce(l.o, ''), q.o) AS k
      FROM quads q LEFT JOIN l ON l.s = q.o WHERE q.p = '{SUBCLASS}') WHERE k = 1),
    walk AS (SELECT s, o AS at, s || ' < ' || o AS path, 1 AS n FROM e
      UNION ALL SELECT w.s, e.o, w.path || ' < ' || e.o, w.n + 1 FROM walk w JOIN e ON e.s = w.at WHERE w.n < 12)
    SELECT s AS iri, arg_max(path, n) AS path, false AS cycle FROM walk GROUP BY s""")
def primary_parent_paths(src):
    q = src.loaded("catalog")
    named = ag.preferred_label(q).select(F.col("iri").alias("parent"), F.col("label").alias("parent_label"))
    edges = q.filter(F.col("p") == SUBCLASS).select(F.col("s").alias("iri"), F.col("o").alias("parent")).distinct()
    rows = edges.join(named, "parent", "left").fillna("", ["parent_label"])
    return ag.entity_paths(rows, 12).select("iri", F.array_join("path", " < ").alias("path"), "cycle")


# -- ordering ---------------------------------------------------------------

@query("S1", "mixed_terms_in_term_order", data="customers", sql=f"""
    SELECT o, n FROM (SELECT s, o, row_number() OVER (ORDER BY CASE WHEN o_kind = 'iri' THEN 2 ELSE 3 END,
      CASE WHEN o_datatype IS NULL THEN 1 ELSE 0 END, cast(CASE WHEN o_datatype IS NOT NULL THEN o END AS double), o, s) AS n
      FROM quads WHERE p IN ('{NATION}', '{BALANCE}', '{SEGMENT}')) WHERE n <= 500""")
def mixed_terms_in_term_order(src):
    q = src.quads("customers").filter(F.col("p").isin(NATION, BALANCE, SEGMENT))
    from quadrille.session import global_index
    rows = q.select("s", t.object_term().alias("x"))
    out = global_index(rows, [t.order_key(F.col("x")), F.col("s")], "n").filter("n < 500")
    return out.select(F.col("x.value").alias("o"), (F.col("n") + 1).alias("n"))


@query("S2", "slice_with_offset", data="customers", sql=f"""
    SELECT s, o FROM {_q(LABEL)} ORDER BY o LIMIT 25 OFFSET 40""")
def slice_with_offset(src):
    rows = pt.match(src.quads("customers"), "?s", LABEL, "?o")
    return lex(od.slice_(od.order_by(rows, (F.col("o"), "asc")), 25, 40))


@query("S3", "grid_sort_numbers_then_text", data="customers suppliers", sql=f"""
    SELECT a.s AS c, b.o AS b FROM {_q(NATION)} a LEFT JOIN {_q(BALANCE)} b ON a.s = b.s
    ORDER BY b.o IS NULL, cast(b.o AS double) DESC, a.s LIMIT 120""")
def grid_sort_numbers_then_text(src):
    q = src.quads("customers", "suppliers")
    rows = pt.optional(pt.match(q, "?c", NATION, "?n"), pt.match(q, "?c", BALANCE, "?b")).withColumn("pos", F.col("c.value"))
    return lex(od.grid_sort(rows, "b", "desc").limit(120), "c", "b")


@query("S4", "clamped_page_and_reveal", sql="""
    SELECT 'last' AS part, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS i, count(*) OVER () AS n FROM customer)
      WHERE i >= (n - 1) // 40 * 40
    UNION ALL SELECT 'reveal', c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS i FROM customer)
      WHERE i // 40 = 2""")
def clamped_page_and_reveal(src):
    c = src.table("customer").select("c_custkey", "c_name")
    last = od.page(c, [F.col("c_name")], 10 ** 9, 40).select(F.lit("last").alias("part"), "c_custkey")
    shown = od.page_of(c, [F.col("c_name")], 40, F.col("c_custkey") == 93).select(F.lit("reveal").alias("part"), "c_custkey")
    return last.unionAll(shown)


@query("S5", "orders_sorted_by_price", sql="""
    SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""")
def orders_sorted_by_price(src):
    rows = pt.orders_with_customer(src.table("orders"), src.table("customer"))
    return od.table_sort(rows, "price", -1).select("o_orderkey", "c_name").limit(200)


@query("S6", "individuals_sorted_by_balance", data="suppliers geo", sql=f"""
    SELECT a.s AS iri, b.o AS balance FROM {_q(NATION)} a LEFT JOIN {_q(BALANCE)} b ON a.s = b.s WHERE a.s LIKE '%supplier%'
    ORDER BY b.o IS NULL, cast(b.o AS double), regexp_extract(a.s, '[^/]*$') LIMIT 7""")
def individuals_sorted_by_balance(src):
    q = src.quads("suppliers", "geo")
    grid = ag.pivot_individuals(ag.individual_values(q, ag.preferred_label(q).select("iri", "label"), EX + "Supplier"))
    out = od.individual_sort(grid, BALANCE, numeric=True).limit(7)
    return out.select("iri", F.element_at(F.col("values")[BALANCE], 1).alias("balance"))


@query("S7", "capped_solutions", data="orders", sql=f"""
    SELECT count(*) AS n, true AS capped FROM (SELECT s FROM {_q(TOTAL)} LIMIT 1000)""")
def capped_solutions(src):
    out = od.cap(pt.match(src.quads("orders"), "?x", TOTAL, "?v"), 1000)
    return out.groupBy("capped").agg(F.count(F.lit(1)).alias("n"))


# -- sets, forms and updates ------------------------------------------------

@query("U1", "union_of_unlike_rows", data="customers suppliers", sql=f"""
    SELECT s AS c, o AS seg, cast(NULL AS varchar) AS see FROM {_q(SEGMENT)}
    UNION ALL SELECT s, NULL, o FROM {_q(SEE_ALSO)}""")
def union_of_unlike_rows(src):
    q = src.quads("customers", "suppliers")
    return lex(up.union_(pt.match(q, "?c", SEGMENT, "?seg"), pt.match(q, "?c", SEE_ALSO, "?see")), "c", "seg", "see")


@query("U2 U3", "distinct_status_priority", data="orders", sql=f"""
    SELECT DISTINCT a.o AS status, b.o AS priority FROM {_q(STATUS)} a JOIN {_q(PRIORITY)} b ON a.s = b.s""")
def distinct_status_priority(src):
    rows = pt.bgp(src.quads("orders"), [("?x", STATUS, "?status"), ("?x", PRIORITY, "?priority")]).drop("x")
    return lex(up.reduced(up.distinct_(rows)))


@query("U4", "ask_large_order", data="orders", sql=f"""
    SELECT (SELECT count(*) > 0 FROM {_q(TOTAL)} WHERE cast(o AS decimal(18,2)) > 499000) AS big,
      (SELECT count(*) > 0 FROM {_q(TOTAL)} WHERE cast(o AS decimal(18,2)) < 0) AS negative""")
def ask_large_order(src):
    rows = pt.match(src.quads("orders"), "?x", TOTAL, "?v")
    big = up.ask(rows.filter(t.term_cmp(F.col("v"), ">", t.literal("499000", t.INTEGER))))
    neg = up.ask(rows.filter(t.term_cmp(F.col("v"), "<", t.literal("0", t.INTEGER))))
    return big.select(F.col("answer").alias("big"), neg.scalar().alias("negative"))


@query("U5", "construct_purchases", data="orders", sql=f"""
    SELECT DISTINCT a.o AS s, '{EX}bought' AS p, a.s AS o, 'iri' AS o_kind FROM {_q(BUYER)} a
    UNION ALL SELECT DISTINCT b.s, '{EX}state', b.o, 'literal' FROM {_q(STATUS)} b""")
def construct_purchases(src):
    rows = pt.bgp(src.quads("orders"), [("?x", BUYER, "?c"), ("?x", STATUS, "?st")])
    out = up.construct(rows, [("?c", EX + "bought", "?x"), ("?x", EX + "state", "?st"), ("?st", EX + "never", "?x")])
    return out.select("s", "p", "o", "o_kind")


@query("U5", "construct_fresh_nodes", data="orders", sql=f"""
    SELECT p, count(*) AS n, count(DISTINCT s) AS nodes FROM (SELECT s, '{EX}about' AS p FROM {_q(BUYER)}
      UNION ALL SELECT s, '{EX}buyer' FROM {_q(BUYER)}) GROUP BY p""")
def construct_fresh_nodes(src):
    rows = pt.match(src.quads("orders"), "?x", BUYER, "?c")
    out = up.construct(rows, [("_:sale", EX + "about", "?x"), ("_:sale", EX + "buyer", "?c")], F.col("x.value"))
    return out.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("nodes"))


@query("U6 P9", "describe_with_blank_nodes", data="definitions", sql=f"""
    WITH roots AS (SELECT DISTINCT s FROM quads WHERE s LIKE '%/part/%1'), walk AS (SELECT s AS root, s AS node FROM roots
      UNION SELECT w.root, q.o FROM walk w JOIN quads q ON q.s = w.node WHERE q.o_kind = 'bnode')
    SELECT DISTINCT q.s, q.p, q.o FROM walk w JOIN quads q ON q.s = w.node""")
def describe_with_blank_nodes(src):
    q = src.loaded("definitions")
    roots = q.filter(F.col("s").rlike(r"/part/.*1$")).select(F.col("s").alias("iri")).distinct()
    return up.describe(q, roots).select("s", "p", "o").distinct()


@query("U7", "iris_in_results", data="customers", sql=f"""
    SELECT s AS iri FROM {_q(NATION)} UNION SELECT o FROM {_q(NATION)}""")
def iris_in_results(src):
    return up.result_iris(pt.bgp(src.quads("customers"), [("?c", NATION, "?n"), ("?c", SEGMENT, "?seg")]))


def _flags(q):
    return up.construct(pt.match(q, "?x", STATUS, t.literal("O")), [("?x", EX + "flag", t.literal("open"))])


@query("U8", "insert_flags", data="orders", sql=f"""
    SELECT s, p, o FROM quads UNION SELECT s, '{EX}flag', 'open' FROM {_q(STATUS)} WHERE o = 'O'""")
def insert_flags(src):
    q = src.quads("orders")
    return up.insert_data(q, _flags(q)).select("s", "p", "o")


@query("U9", "delete_statements", data="orders", sql=f"""
    SELECT s, p, o FROM quads WHERE NOT (p = '{STATUS}' AND o = 'O')""")
def delete_statements(src):
    q = src.quads("orders")
    return up.delete_data(q, q.filter((F.col("p") == STATUS) & (F.col("o") == "O"))).select("s", "p", "o")


@query("U10", "delete_where_cheap", data="orders", sql=f"""
    SELECT s, p, o FROM quads q WHERE NOT (p IN ('{TOTAL}', '{STATUS}') AND s IN
      (SELECT s FROM {_q(TOTAL)} WHERE cast(o AS decimal(18,2)) < 100000))""")
def delete_where_cheap(src):
    q = src.quads("orders")
    where = pt.bgp(q, [("?x", TOTAL, "?v"), ("?x", STATUS, "?st")])
    where = where.filter(t.term_cmp(F.col("v"), "<", t.literal("100000", t.INTEGER)))
    return up.delete_where(q, [("?x", TOTAL, "?v"), ("?x", STATUS, "?st")], where).select("s", "p", "o")


@query("U11", "modify_statuses", data="orders", sql=f"""
    SELECT s, p, CASE WHEN p = '{STATUS}' AND o = 'F' THEN 'finished' ELSE o END AS o FROM quads""")
def modify_statuses(src):
    q = src.quads("orders")
    where = pt.match(q, "?x", STATUS, t.literal("F"))
    out = up.modify(q, where, [("?x", STATUS, t.literal("F"))], [("?x", STATUS, t.literal("finished"))])
    return out.select("s", "p", "o")


@query("U12", "clear_targets", data="customer_graphs customers", sql=f"""
    SELECT 'default' AS target, count(*) FILTER (WHERE g IS NOT NULL) AS n FROM quads
    UNION ALL SELECT 'named', count(*) FILTER (WHERE g IS NULL) FROM quads
    UNION ALL SELECT 'all', 0 UNION ALL SELECT 'one', count(*) FILTER (WHERE g IS NULL OR g <> '{EX}graph/1') FROM quads""")
def clear_targets(src):
    q = src.quads("customer_graphs", "customers")
    parts = [("default", "default"), ("named", "named"), ("all", "all"), ("one", EX + "graph/1")]
    rows = [up.clear(q, x).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("target"), "n") for k, x in parts]
    return up.union_(*rows)


@query("U13", "graph_management", data="customer_graphs", sql=f"""
    SELECT 'add' AS op, g, count(*) AS n FROM (SELECT s, p, o, g FROM quads UNION SELECT s, p, o, '{EX}graph/2' FROM quads WHERE g = '{EX}graph/1') GROUP BY g
    UNION ALL SELECT 'copy', g, count(*) FROM (SELECT s, p, o, g FROM quads WHERE g <> '{EX}graph/2' UNION SELECT s, p, o, '{EX}graph/2' FROM quads WHERE g = '{EX}graph/1') GROUP BY g
    UNION ALL SELECT 'move', g, count(*) FROM (SELECT s, p, o, g FROM quads WHERE g NOT IN ('{EX}graph/1', '{EX}graph/2') UNION SELECT s, p, o, '{EX}graph/2' FROM quads WHERE g = '{EX}graph/1') GROUP BY g""")
def graph_management(src):
    q, a, b = src.quads("customer_graphs"), EX + "graph/1", EX + "graph/2"
    parts = [("add", up.add_graph(q, a, b)), ("copy", up.copy_graph(q, a, b)), ("move", up.move_graph(q, a, b))]
    return up.union_(*[d.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(k)) for k, d in parts])
