"""Registered queries: scans, filters, expressions, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import aggregates as ag, ordering as od, patterns as pt
from quadrille.plans.common import (BALANCE, BUYER, DATE, EX, LABEL, NATION, REF, REGION, SEGMENT,
                                    STATUS, TOTAL, TYPE, XSD, lex)
from quadrille.plans.registry import query



def _q(p: str) -> str:
    return f"(SELECT s, o FROM quads WHERE p = '{p}')"


@query("I12 F1 J1 F3 S1 S2", "expensive_open_orders", data="orders", sql=f"""
    SELECT a.s AS ordered, b.o AS price, c.o AS ref
    FROM {_q(STATUS)} a JOIN {_q(TOTAL)} b ON a.s = b.s JOIN {_q(REF)} c ON a.s = c.s
    WHERE a.o = 'O' AND cast(b.o AS decimal(18,2)) > 400000
    ORDER BY cast(b.o AS decimal(18,2)) DESC, a.s LIMIT 100""")
def expensive_open_orders(src):
    q = src.stored("orders").by_subject
    rows = pt.bgp(q, [("?ordered", TOTAL, pt.Bound("?price", ">", "400000")), ("?ordered", STATUS, t.literal("O")), ("?ordered", REF, "?ref")])
    rows = od.order_by(rows, (F.col("price"), "desc"), (F.col("ordered"), "asc"))
    return lex(od.slice_(rows, 100))


@query("F1", "scan_by_predicate_and_object", data="customers", sql=f"""
    SELECT s, o FROM quads WHERE p = '{NATION}' AND o = '{EX}nation/7'""")
def scan_by_predicate_and_object(src):
    return pt.scan(src.quads("customers"), p=NATION, o=EX + "nation/7").select("s", "o")


@query("F2", "project_expression", data="orders", sql=f"""
    SELECT s AS ordered, cast(cast(o AS decimal(18,2)) * 2 AS decimal(18,2)) AS doubled FROM {_q(TOTAL)}""")
def project_expression(src):
    rows = pt.match(src.quads("orders"), "?ordered", TOTAL, "?price")
    out = pt.project(rows, "ordered", doubled=t.arith(F.col("price"), "*", t.literal("2", t.INTEGER)))
    return out.select(F.col("ordered.value").alias("ordered"), F.col("doubled.value").try_cast("decimal(18,2)").alias("doubled"))


@query("F3 F6", "filter_typed_comparison", data="customers", sql=f"""
    SELECT s AS c, o AS b FROM {_q(BALANCE)} WHERE cast(o AS decimal(18,2)) <= 0""")
def filter_typed_comparison(src):
    rows = pt.match(src.quads("customers"), "?c", BALANCE, "?b")
    return lex(pt.filter_(rows, t.term_cmp(F.col("b"), "<=", t.literal("0", t.INTEGER))))


@query("F4", "bind_error_leaves_unbound", data="customers", sql=f"""
    SELECT s AS c, o AS v, CASE WHEN o_datatype = '{XSD}decimal'
      THEN cast(cast(o AS decimal(18,2)) + 1 AS decimal(18,2)) END AS more
    FROM quads WHERE p IN ('{BALANCE}', '{SEGMENT}')""")
def bind_error_leaves_unbound(src):
    rows = pt.match(src.quads("customers").filter(F.col("p").isin(BALANCE, SEGMENT)), "?c", "?p", "?v").drop("p")
    rows = pt.bind(rows, "more", t.arith(F.col("v"), "+", t.literal("1", t.INTEGER)))
    return rows.select(F.col("c.value").alias("c"), F.col("v.value").alias("v"),
                       F.col("more.value").try_cast("decimal(18,2)").alias("more"))


@query("F5", "inline_values_with_undef", data="customers", sql=f"""
    WITH r AS (SELECT a.s AS c, a.o AS n, b.o AS seg FROM {_q(NATION)} a JOIN {_q(SEGMENT)} b ON a.s = b.s)
    SELECT c, n, seg, 'first' AS tag FROM r WHERE n = '{EX}nation/3' AND seg = 'BUILDING'
    UNION ALL SELECT c, n, seg, 'second' FROM r WHERE seg = 'MACHINERY'""")
def inline_values_with_undef(src):
    rows = pt.bgp(src.quads("customers"), [("?c", NATION, "?n"), ("?c", SEGMENT, "?seg")])
    out = pt.values(rows, [
        {"n": t.resource(F.lit(EX + "nation/3")), "seg": t.literal("BUILDING"), "tag": t.literal("first")},
        {"n": None, "seg": t.literal("MACHINERY"), "tag": t.literal("second")}])
    return lex(out, "c", "n", "seg", "tag")


@query("F6", "compare_numbers_with_strings", data="customers orders", sql=f"""
    SELECT p, count(*) AS n, count(*) FILTER (WHERE o_datatype = '{XSD}decimal' AND cast(o AS decimal(18,2)) > 5000) AS above,
      count(*) FILTER (WHERE o_datatype = '{XSD}decimal') AS comparable
    FROM quads WHERE o_kind = 'literal' AND p <> '{DATE}' GROUP BY p""")
def compare_numbers_with_strings(src):
    q = src.quads("customers", "orders").filter((F.col("o_kind") == "literal") & (F.col("p") != DATE))
    above = t.term_cmp(t.object_term(), ">", t.literal("5000", t.INTEGER))
    return q.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(above).alias("above"),
                              F.count(above).alias("comparable"))


@query("F7", "date_equality_with_unknown_zone", data="orders", sql=f"""
    SELECT s AS ordered, o AS d,
      CASE WHEN abs(date_diff('day', DATE '1997-05-28', cast(o AS date))) >= 1 THEN 'false' ELSE 'unknown' END AS zoned,
      CASE WHEN o = '1997-05-28' THEN 'true' ELSE 'false' END AS plain
    FROM {_q(DATE)}""")
def date_equality_with_unknown_zone(src):
    rows = pt.match(src.quads("orders"), "?ordered", DATE, "?d")
    zoned = t.date_eq(F.col("d"), t.literal("1997-05-28Z", t.DATE))
    plain = t.term_cmp(F.col("d"), "=", t.literal("1997-05-28", t.DATE))
    return rows.select(F.col("ordered.value").alias("ordered"), F.col("d.value").alias("d"),
                       F.coalesce(zoned.cast("string"), F.lit("unknown")).alias("zoned"), plain.cast("string").alias("plain"))


@query("F8", "arithmetic_with_promotion", data="orders", sql=f"""
    SELECT s AS ordered, cast(cast(o AS decimal(18,2)) - 1000 AS decimal(18,2)) AS less,
      cast(-cast(o AS decimal(18,2)) AS decimal(18,2)) AS neg, cast(NULL AS varchar) AS by_zero,
      '{XSD}decimal' AS kind FROM {_q(TOTAL)}""")
def arithmetic_with_promotion(src):
    rows = pt.match(src.quads("orders"), "?ordered", TOTAL, "?x")
    x = F.col("x")
    less = t.arith(x, "-", t.literal("1000", t.INTEGER))
    return rows.select(F.col("ordered.value").alias("ordered"), less["value"].try_cast("decimal(18,2)").alias("less"),
                       t.negate(x)["value"].try_cast("decimal(18,2)").alias("neg"),
                       t.arith(x, "/", t.literal("0", t.INTEGER))["value"].alias("by_zero"), less["datatype"].alias("kind"))


@query("F9", "effective_boolean_value", data="customers", sql=f"""
    SELECT p, count(*) AS n,
      count(*) FILTER (WHERE o_kind = 'literal' AND CASE WHEN o_datatype IS NULL THEN length(o) > 0 ELSE cast(o AS decimal(18,2)) <> 0 END) AS truthy,
      count(*) FILTER (WHERE o_kind <> 'literal') AS errors
    FROM quads GROUP BY p""")
def effective_boolean_value(src):
    v = t.ebv(t.object_term())
    return src.quads("customers").groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v).alias("truthy"), F.count_if(v.isNull()).alias("errors"))


@query("F9", "three_valued_logic", data="customers", sql=f"""
    SELECT a.s AS c FROM {_q(BALANCE)} a JOIN {_q(SEGMENT)} b ON a.s = b.s
    WHERE cast(a.o AS decimal(18,2)) > 9000 OR (b.o = 'BUILDING' AND NOT cast(a.o AS decimal(18,2)) > 0)""")
def three_valued_logic(src):
    rows = pt.bgp(src.quads("customers"), [("?c", BALANCE, "?b"), ("?c", SEGMENT, "?seg")])
    rich = t.term_cmp(F.col("b"), ">", t.literal("9000", t.INTEGER))
    poor = t.not_(t.term_cmp(F.col("b"), ">", t.literal("0", t.INTEGER)))
    error = t.term_cmp(F.col("seg"), ">", t.literal("1", t.INTEGER))
    builds = t.term_cmp(F.col("seg"), "=", t.literal("BUILDING"))
    return lex(pt.filter_(rows, t.or_(t.or_(rich, t.and_(builds, poor)), error)), "c")


@query("F10", "same_term_pairs", data="customers suppliers", sql=f"""
    SELECT c.s AS c, s.s AS sup FROM {_q(NATION)} c JOIN {_q(NATION)} s ON c.o = s.o
    WHERE c.s LIKE '%customer%' AND s.s LIKE '%supplier%'""")
def same_term_pairs(src):
    c = pt.match(src.quads("customers"), "?c", NATION, "?n")
    s = pt.match(src.quads("suppliers"), "?sup", NATION, "?n2")
    rows = pt.theta_join(c, s, equal=[(F.col("n.value"), F.col("n2.value"))], condition=t.same_term(F.col("n"), F.col("n2")))
    return lex(rows, "c", "sup")


@query("F10", "same_term_pair_counts", data="customers suppliers", sql=f"""
    SELECT c.o AS nation, c.n * s.n AS pairs FROM (SELECT o, count(*) AS n FROM {_q(NATION)} WHERE s LIKE '%customer%' GROUP BY o) c
    JOIN (SELECT o, count(*) AS n FROM {_q(NATION)} WHERE s LIKE '%supplier%' GROUP BY o) s ON c.o = s.o""")
def same_term_pair_counts(src):
    """The pairs of all customers and suppliers, counted per term and not listed."""
    c = pt.match(src.quads("customers"), "?c", NATION, "?n").groupBy("n").agg(F.count(F.lit(1)).alias("n_c"))
    s = pt.match(src.quads("suppliers"), "?sup", NATION, "?n2").groupBy("n2").agg(F.count(F.lit(1)).alias("n_sup"))
    rows = pt.theta_join(c, s, equal=[(F.col("n.value"), F.col("n2.value"))], condition=t.same_term(F.col("n"), F.col("n2")))
    return rows.select(F.col("n.value").alias("nation"), (F.col("n_c") * F.col("n_sup")).alias("pairs"))


@query("F11", "order_table_filter", sql="""
    SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'O' AND lower(concat_ws(' ', o_orderpriority, c_name, c_mktsegment)) LIKE '%urgent%building%'
       OR o_orderstatus = 'O' AND lower(concat_ws(' ', o_orderpriority, c_name, c_mktsegment)) LIKE '%00012%'""")
def order_table_filter(src):
    rows = pt.orders_with_customer(src.table("orders"), src.table("customer"))
    fields = ["o_orderpriority", "c_name", "c_mktsegment"]
    first = pt.table_filter(rows, {"o_orderstatus": "O"}, "00012", fields)
    both = pt.table_filter(pt.table_filter(rows, {"o_orderstatus": "O"}, "urgent", fields), None, "building", fields)
    return first.unionByName(both).select("o_orderkey", "c_name").distinct()


@query("F12", "substring_search", data="catalog", sql=f"""
    SELECT s AS iri, o AS name FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY
      CASE WHEN coalesce(o_lang, '') = '' THEN 0 ELSE 2 END, pos) AS k FROM quads WHERE p = '{LABEL}') WHERE k = 1
      AND (lower(s) LIKE '%ring%' OR lower(o) LIKE '%ring%') ORDER BY s LIMIT 80""")
def substring_search(src):
    names = ag.preferred_label(src.quads("catalog")).select("iri", F.col("label").alias("name"))
    return pt.substring_search(names, "ring", 80)


@query("F13", "validate_price_and_rating_cells", sql="""
    SELECT o_orderkey, CASE WHEN x < 0 THEN 'negative' WHEN x > 500 THEN 'over limit' END AS price_reason,
      CASE WHEN x BETWEEN 0 AND 500 THEN cast(x AS decimal(18,2)) END AS price_value,
      CASE WHEN r > 5 THEN 'out of range' END AS rating_reason, CASE WHEN r <= 5 THEN r END AS rating_value
    FROM (SELECT o_orderkey, cast(o_totalprice AS decimal(18,2)) - 1000 AS x, cast(substr(o_orderpriority, 1, 1) AS integer) * 2 AS r FROM orders)""")
def validate_price_and_rating_cells(src):
    raw = src.table("orders").select(
        "o_orderkey", F.concat(F.lit(" £"), (F.col("o_totalprice").try_cast("decimal(18,2)") - 1000).cast("string")).alias("price"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 2).cast("string").alias("rating"))
    out = pt.validate_cells(raw)
    return out.select("o_orderkey", "price_reason", F.col("price_value").try_cast("decimal(18,2)").alias("price_value"),
                      "rating_reason", "rating_value")


# -- joins ------------------------------------------------------------------

@query("J1 P1", "order_buyer_nation_region", data="orders customers geo", sql=f"""
    SELECT a.s AS ordered, d.o AS region FROM {_q(BUYER)} a JOIN {_q(NATION)} b ON a.o = b.s
    JOIN {_q(REGION)} c ON b.o = c.s JOIN {_q(LABEL)} d ON c.o = d.s""")
def order_buyer_nation_region(src):
    q = src.loaded("orders", "customers", "geo")
    rows = pt.bgp(q, [("?ordered", BUYER, "?c"), ("?c", NATION, "?n"), ("?n", REGION, "?r"), ("?r", LABEL, "?region")])
    return lex(rows, "ordered", "region")


@query("J1", "compatible_join_with_unbound", data="customers suppliers", sql=f"""
    WITH sup AS (SELECT a.s AS sup, a.o AS n, b.o AS bal FROM {_q(NATION)} a LEFT JOIN {_q(BALANCE)} b ON a.s = b.s WHERE a.s LIKE '%supplier%'),
    cus AS (SELECT a.s AS c, a.o AS n, CASE WHEN cast(b.o AS decimal(18,2)) < 0 THEN b.o END AS bal
      FROM {_q(NATION)} a JOIN {_q(BALANCE)} b ON a.s = b.s WHERE a.s LIKE '%customer%')
    SELECT sup, c, coalesce(sup.bal, cus.bal) AS bal FROM sup JOIN cus ON sup.n = cus.n
      AND (sup.bal = cus.bal OR sup.bal IS NULL OR cus.bal IS NULL)""")
def compatible_join_with_unbound(src):
    s, c = src.quads("suppliers"), src.quads("customers")
    sup = pt.optional(pt.match(s, "?sup", NATION, "?n"), pt.match(s, "?sup", BALANCE, "?bal"))
    cus = pt.bgp(c, [("?c", NATION, "?n"), ("?c", BALANCE, "?bal")])
    cus = cus.withColumn("bal", F.when(t.term_cmp(F.col("bal"), "<", t.literal("0", t.INTEGER)), F.col("bal")))
    return lex(pt.join_compatible(sup, cus, ["bal"]), "sup", "c", "bal")


@query("J1", "compatible_join_counts", data="customers suppliers", sql=f"""
    WITH sup AS (SELECT a.o AS n, b.o AS bal, count(*) AS k FROM {_q(NATION)} a LEFT JOIN {_q(BALANCE)} b ON a.s = b.s WHERE a.s LIKE '%supplier%' GROUP BY ALL),
    cus AS (SELECT a.o AS n, CASE WHEN cast(b.o AS decimal(18,2)) < 0 THEN b.o END AS bal, count(*) AS k
      FROM {_q(NATION)} a JOIN {_q(BALANCE)} b ON a.s = b.s WHERE a.s LIKE '%customer%' GROUP BY ALL)
    SELECT sup.n AS nation, coalesce(sup.bal, cus.bal) AS bal, cast(sum(sup.k * cus.k) AS bigint) AS pairs FROM sup JOIN cus ON sup.n = cus.n
      AND (sup.bal = cus.bal OR sup.bal IS NULL OR cus.bal IS NULL) GROUP BY ALL""")
def compatible_join_counts(src):
    """The pairs of all suppliers and customers, counted per solution and not listed."""
    s, c = src.quads("suppliers"), src.quads("customers")
    sup = pt.optional(pt.match(s, "?sup", NATION, "?n"), pt.match(s, "?sup", BALANCE, "?bal"))
    cus = pt.bgp(c, [("?c", NATION, "?n"), ("?c", BALANCE, "?bal")])
    cus = cus.withColumn("bal", F.when(t.term_cmp(F.col("bal"), "<", t.literal("0", t.INTEGER)), F.col("bal")))
    sup, cus = (df.groupBy("n", "bal").agg(F.count(F.lit(1)).alias(k)) for df, k in ((sup, "n_sup"), (cus, "n_c")))
    rows = pt.join_compatible(sup, cus, ["bal"])
    return rows.groupBy(F.col("n.value").alias("nation"), F.col("bal.value").alias("bal")).agg(F.sum(F.col("n_sup") * F.col("n_c")).alias("pairs"))


@query("J2", "optional_with_inner_filter", data="customers orders", sql=f"""
    SELECT a.s AS c, b.s AS ordered FROM {_q(SEGMENT)} a
    LEFT JOIN (SELECT x.s, x.o AS c, y.o AS total FROM {_q(BUYER)} x JOIN {_q(TOTAL)} y ON x.s = y.s) b
      ON b.c = a.s AND cast(b.total AS decimal(18,2)) > 450000""")
def optional_with_inner_filter(src):
    left = pt.match(src.loaded("customers"), "?c", SEGMENT, "?seg").drop("seg")
    right = pt.bgp(src.loaded("orders"), [("?ordered", BUYER, "?c"), ("?ordered", TOTAL, "?total")])
    out = pt.optional(left, right, lambda l, r: t.term_cmp(r["total"], ">", t.literal("450000", t.INTEGER)))
    return lex(out, "c", "ordered")


@query("J3", "minus_shared_variables", data="customers orders", sql=f"""
    SELECT a.s AS c, a.o AS seg FROM {_q(SEGMENT)} a WHERE NOT EXISTS (
      SELECT 1 FROM {_q(BUYER)} x JOIN {_q(STATUS)} y ON x.s = y.s WHERE x.o = a.s AND y.o = 'P')""")
def minus_shared_variables(src):
    left = pt.match(src.quads("customers"), "?c", SEGMENT, "?seg")
    right = pt.bgp(src.quads("orders"), [("?ordered", BUYER, "?c"), ("?ordered", STATUS, t.literal("P"))])
    return lex(pt.minus(left, right))


@query("J3", "minus_with_unbound", data="suppliers customers", sql=f"""
    WITH sup AS (SELECT a.s AS sup, a.o AS n, b.o AS bal FROM {_q(NATION)} a LEFT JOIN {_q(BALANCE)} b ON a.s = b.s WHERE a.s LIKE '%supplier%'),
    cus AS (SELECT a.o AS n, b.o AS bal FROM {_q(NATION)} a JOIN {_q(BALANCE)} b ON a.s = b.s
      WHERE a.s LIKE '%customer%' AND cast(b.o AS decimal(18,2)) < -900)
    SELECT sup, n, bal FROM sup WHERE NOT EXISTS (SELECT 1 FROM cus WHERE cus.n = sup.n AND (sup.bal IS NULL OR cus.bal = sup.bal))""")
def minus_with_unbound(src):
    s, c = src.quads("suppliers"), src.quads("customers")
    sup = pt.optional(pt.match(s, "?sup", NATION, "?n"), pt.match(s, "?sup", BALANCE, "?bal"))
    cus = pt.bgp(c, [("?c", NATION, "?n"), ("?c", BALANCE, "?bal")]).drop("c")
    cus = cus.filter(t.term_cmp(F.col("bal"), "<", t.literal("-900", t.INTEGER)))
    return lex(pt.minus(sup, cus, ["bal"]), "sup", "n", "bal")


@query("J4", "customers_with_open_order", data="customers orders", sql=f"""
    SELECT a.s AS c FROM {_q(SEGMENT)} a WHERE EXISTS (
      SELECT 1 FROM {_q(BUYER)} x JOIN {_q(STATUS)} y ON x.s = y.s WHERE x.o = a.s AND y.o = 'O')""")
def customers_with_open_order(src):
    left = pt.match(src.loaded("customers"), "?c", SEGMENT, "?seg").drop("seg")
    right = pt.bgp(src.loaded("orders"), [("?ordered", BUYER, "?c"), ("?ordered", STATUS, t.literal("O"))])
    return lex(pt.exists(left, right))


@query("J5", "customers_without_large_order", data="customers orders", sql=f"""
    SELECT a.s AS c FROM {_q(SEGMENT)} a WHERE a.s NOT IN (SELECT x.o FROM {_q(BUYER)} x JOIN {_q(TOTAL)} y ON x.s = y.s WHERE cast(y.o AS double) > 400000)""")
def customers_without_large_order(src):
    left = pt.match(src.quads("customers"), "?c", SEGMENT, "?seg").drop("seg")
    big = pt.bgp(src.quads("orders"), [("?ordered", BUYER, "?c"), ("?ordered", TOTAL, "?x")])
    big = big.filter(t.term_cmp(F.col("x"), ">", t.literal("400000", t.INTEGER)))
    return lex(pt.not_exists(left, big))


@query("J6", "graph_variable_aggregate", data="customer_graphs", sql=f"""
    SELECT g, count(*) AS n, cast(max(cast(o AS decimal(18,2))) AS varchar) AS top FROM quads WHERE p = '{BALANCE}' GROUP BY g""")
def graph_variable_aggregate(src):
    rows = pt.graph(src.quads("customer_graphs"), "?g", lambda q: pt.match(q, "?c", BALANCE, "?b", "?g"))
    out = ag.group(rows, ["g"], n=F.count(F.lit(1)), top=ag.max_(F.col("b")))
    return out.select(F.col("g.value").alias("g"), "n", F.col("top.value").alias("top"))


@query("J6", "graph_constant_with_optional", data="customer_graphs customers", sql=f"""
    SELECT a.s AS c, b.o AS name FROM (SELECT s FROM quads WHERE p = '{SEGMENT}' AND o = 'BUILDING' AND g = '{EX}graph/4') a
    LEFT JOIN (SELECT s, o FROM quads WHERE p = '{LABEL}' AND g = '{EX}graph/4') b ON a.s = b.s""")
def graph_constant_with_optional(src):
    def inside(q):
        return pt.optional(pt.match(q, "?c", SEGMENT, t.literal("BUILDING")), pt.match(q, "?c", LABEL, "?name"))
    return lex(pt.graph(src.quads("customer_graphs", "customers"), EX + "graph/4", inside))


@query("J7", "dataset_selection", data="customer_graphs", sql=f"""
    SELECT s, p, o, g FROM (SELECT DISTINCT s, p, o, cast(NULL AS varchar) AS g FROM quads WHERE g IN ('{EX}graph/1', '{EX}graph/2')
    UNION ALL SELECT s, p, o, g FROM quads WHERE g = '{EX}graph/3')""")
def dataset_selection(src):
    q = pt.dataset(src.quads("customer_graphs"), [EX + "graph/1", EX + "graph/2"], [EX + "graph/3"])
    return q.select("s", "p", "o", "g")


@query("J8", "subquery_best_order", data="orders customers", sql=f"""
    SELECT b.o AS c, cast(max(cast(a.o AS decimal(18,2))) AS varchar) AS top, max(d.o) AS name
    FROM {_q(TOTAL)} a JOIN {_q(BUYER)} b ON a.s = b.s JOIN {_q(LABEL)} d ON d.s = b.o GROUP BY b.o""")
def subquery_best_order(src):
    inner = pt.bgp(src.loaded("orders"), [("?ordered", TOTAL, "?x"), ("?ordered", BUYER, "?c")])
    inner = ag.group(inner, ["c"], top=ag.max_(F.col("x")))
    return lex(pt.subquery(inner, pt.match(src.loaded("customers"), "?c", LABEL, "?name")), "c", "top", "name")


@query("J9", "theta_join_on_sum", data="customers suppliers", sql=f"""
    SELECT c.s AS c, s.s AS sup FROM {_q(BALANCE)} c JOIN {_q(BALANCE)} s
      ON abs(cast(c.o AS double) - cast(s.o AS double)) <= 500
    WHERE c.s LIKE '%customer%' AND s.s LIKE '%supplier%'""")
def theta_join_on_sum(src):
    c = pt.match(src.quads("customers"), "?c", BALANCE, "?b")
    s = pt.match(src.quads("suppliers"), "?sup", BALANCE, "?sb")
    return lex(pt.theta_join(c, s, band=(F.col("b.value"), F.col("sb.value"), 500.0)), "c", "sup")


@query("J10", "order_customer_lookup", sql="""
    SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def order_customer_lookup(src):
    return pt.orders_with_customer(src.table("orders"), src.table("customer")).select("o_orderkey", "c_name")


@query("J11", "class_instance_counts", data="orders customers suppliers geo", sql=f"""
    SELECT o AS class, count(DISTINCT s) AS instances FROM quads WHERE p = '{TYPE}' GROUP BY o""")
def class_instance_counts(src):
    return pt.instance_counts(src.quads("orders", "customers", "suppliers", "geo"))


@query("J12", "instance_report_page", data="customers", sql=f"""
    SELECT a.s AS iri, b.o AS label, 'Customer' AS classes,
      (SELECT count(*) FROM {_q(LABEL)} WHERE lower(o) LIKE '%0001%') AS filtered
    FROM (SELECT s FROM quads WHERE p = '{TYPE}' AND o = '{EX}Customer') a JOIN {_q(LABEL)} b ON a.s = b.s
    WHERE lower(b.o) LIKE '%0001%' ORDER BY a.s LIMIT 20 OFFSET 20""")
def instance_report_page(src):
    q = src.quads("customers")
    labels = ag.preferred_label(q).select("iri", "label")
    out = pt.instance_report(q, labels, EX + "Customer", "0001", 20, 20)
    return out.select("iri", "label", F.array_join("classes", ",").alias("classes"), F.col("filtered").cast("long").alias("filtered"))
