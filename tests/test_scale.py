"""Labels, strong components, stored quads and exact sums against plain versions."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quadrille import model as m
from quadrille.functions import terms as t, text as tx
from quadrille.operators import aggregates as ag, entities as en, patterns as pt, reachability as r, search as se, updates as up
from quadrille.sources import store


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    pairs = set()
    for a in {x for e in edges for x in e}:
        seen, todo = set(), list(out.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        pairs |= {(a, b) for b in seen}
    return pairs


def graph(seed, n, share, acyclic):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(n * share))}
    edges = {(max(e), min(e)) for e in edges if e[0] != e[1]} if acyclic else edges
    return sorted((f"n{a:03d}", f"n{b:03d}") for a, b in edges)


@pytest.mark.parametrize("seed, n, share, acyclic", [(1, 40, 1.8, True), (2, 30, 1.1, False)])
def test_labels_equal_the_closure(spark, seed, n, share, acyclic):
    edges = graph(seed, n, share, acyclic)
    want = closure(edges)
    ix = r.index(spark.createDataFrame(edges, "src string, dst string"))
    got = [tuple(x) for x in r.pairs(ix).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {x["node"]: x["n"] for x in r.descendant_counts(ix).collect()}
    assert counts == {b: sum(1 for a, c in want if c == b and a != b) for _, b in want if any(a != b for a, c in want if c == b)}
    names = sorted({x for e in edges for x in e}) + ["elsewhere"]
    asked = [(a, b) for a in names[::3] + ["elsewhere"] for b in names]
    met = r.reaching(ix, spark.createDataFrame(asked, "a string, b string"), "a", "b").collect()
    assert {tuple(x) for x in met} == {x for x in asked if x in want and x[0] != x[1]}


def test_extra_intervals_pass_unmarked_places(spark, monkeypatch):
    """A long branch above the end of a further edge, and pieces smaller than its intervals."""
    monkeypatch.setattr(r, "PIECE", 4)
    edges = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)] + [(f"x{i:02d}", "hub") for i in range(9)] + [("x03", "c02"), ("hub", "c04"), ("hub", "top"), ("c12", "top")]
    ix = r.index(spark.createDataFrame(edges, "src string, dst string"))
    assert {tuple(x) for x in r.pairs(ix).collect()} == closure(edges)
    assert {x["node"]: x["n"] for x in r.descendant_counts(ix).collect()}["c03"] == len({a for a, b in closure(edges) if b == "c03"})


def test_no_edges(spark):
    ix = r.index(spark.createDataFrame([], "src string, dst string"))
    assert r.pairs(ix).count() == 0 and r.descendant_counts(ix).count() == 0
    assert r.strong_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_chain_beside_a_ring_ends_in_few_rounds(spark, monkeypatch):
    rounds = []
    plain = r.stored
    monkeypatch.setattr(r, "stored", lambda df: rounds.append(1) or plain(df))
    chain = spark.range(100_000).select(F.format_string("c%06d", "id").alias("src"), F.format_string("c%06d", F.col("id") + 1).alias("dst"))
    ring = spark.range(7).select(F.format_string("r%d", "id").alias("src"), F.format_string("r%d", (F.col("id") + 1) % 7).alias("dst"))
    got = r.strong_components(chain.unionByName(ring)).collect()
    assert {tuple(x) for x in got} == {(f"r{i}", "r0") for i in range(7)}
    assert len(rounds) < 30


def test_long_chain_and_wide_star_are_counted(spark):
    chain = spark.range(20_000).select(F.format_string("c%06d", "id").alias("src"), F.format_string("c%06d", F.col("id") + 1).alias("dst"))
    star = spark.range(200_000).select(F.format_string("s%07d", "id").alias("src"), F.lit("star").alias("dst"))
    counts = r.descendant_counts(r.index(chain.unionByName(star)))
    assert counts.filter("node = 'star'").first()["n"] == 200_000
    assert counts.filter("node = 'c020000'").first()["n"] == 20_000
    assert counts.filter("node LIKE 'c%'").agg(F.sum("n")).first()[0] == 20_000 * 20_001 // 2


def test_stored_quads_prune_and_keep_all(spark):
    rows = [(f"e{i}", p, o, kind, dt, None, None, i) for i in range(50) for p, o, kind, dt in
            [("p:price", str(i * 1.5), "literal", t.DECIMAL), ("p:type", f"k{i % 3}", "iri", None), ("p:note", "x", "literal", None)]]
    quads = spark.createDataFrame(rows, m.QUADS)
    st = store.save(quads, buckets=4)
    assert sorted(map(tuple, st.quads.collect())) == sorted(rows, key=lambda x: x)
    some = store.matching(st, "p:price", least=30, most=45)
    assert {x["s"] for x in some.collect()} == {f"e{i}" for i in range(50) if 30 <= i * 1.5 <= 45}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(num" in plan
    back = store.matching(st, "p:type", o="k1")
    assert back.count() == 17
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")     # shows the bucket in the plan
    try:
        assert "SelectedBucketsCount: 1 out of 4" in store.matching(st, "p:type", o="k1")._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    star = pt.bgp(st.by_subject, [("?e", "p:price", pt.Bound("?v", ">", "60")), ("?e", "p:type", "?k"), ("?e", "p:note", t.literal("x"))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = star._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert sorted((x["e"]["value"], x["v"]["value"], x["k"]["value"]) for x in star.collect()) == sorted((f"e{i}", str(i * 1.5), f"k{i % 3}") for i in range(41, 50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_predicates_share_digest_folders(spark):
    long = "http://example.org/" + "é" * 400
    st = store.save(spark.createDataFrame([("a", long, "b", "iri", None, None, None, 1), ("a", "p", "1", "literal", t.INTEGER, None, None, 2)], m.QUADS), buckets=2)
    assert {x["p"] for x in st.quads.collect()} == {long, "p"}
    assert store.matching(st, long, s="a").count() == store.matching(st, long, o="b").count() == 1


def term(v, dt):
    return (v, "literal", dt, None)


@pytest.mark.parametrize("values, total, mean", [
    (["1234567890123456789012345", "1"], "1234567890123456789012346", "617283945061728394506173"),
    (["-7", "2", "3"], "-2", str(-Decimal("0.666666666666666667"))),
    (["9" * 37, "1", "1"], "1" + "0" * 36 + "1", None), (["5"], "5", "5"), (["0", "0"], "0", "0"), (["-5", "5"], "0", "0")])
def test_integers_add_and_average_exactly(spark, values, total, mean):
    df = spark.createDataFrame([(term(v, t.INTEGER),) for v in values], "x struct<value string, kind string, datatype string, lang string>")
    row = ag.group(df, [], s=ag.sum_(F.col("x")), a=ag.avg_(F.col("x"))).first()
    assert (row["s"]["value"], row["s"]["datatype"]) == (total, t.INTEGER)
    assert row["a"]["datatype"] == t.DECIMAL and (mean is None or row["a"]["value"] == mean)


def test_long_lists_keep_their_members(spark):
    n = 5000
    cell = F.format_string("_:c%05d", "id")
    rest = F.when(F.col("id") == n - 1, F.lit(m.NIL)).otherwise(F.format_string("_:c%05d", F.col("id") + 1))
    cells = spark.range(n)
    quads = m.resource_quads(cells, cell, F.lit(m.FIRST), F.format_string("m%05d", "id")).unionByName(m.resource_quads(cells, cell, F.lit(m.REST), rest))
    heads = spark.createDataFrame([(None, "_:c00000")], "g string, head string")
    members, issues = en.rdf_lists(quads, heads)
    got = members.orderBy("pos").collect()
    assert [(x["pos"], x["member"]) for x in got] == [(i, f"m{i:05d}") for i in range(n)] and issues.count() == 0


def test_texts_that_can_name_an_entity(spark):
    yes = ["red apple", "R&D", "AT&T Labs", "a - b", "5% (new)", "x.y", "a" * 256]
    no = ["", "   ", "label:apple", "see rdfs:label: x", "ex:thing", "<http://a.b/c>", "/ab+c/I", "a|b", "x*", "[ab]", "(?i)x", "a.+b", "b{2,}", "c:\\d", "a" * 257]
    rows = spark.createDataFrame([(x,) for x in yes + no], "x string").select("x", tx.can_name_entity(F.col("x")).alias("ok")).collect()
    assert [x["x"] for x in rows if x["ok"]] == yes


def test_inserts_keep_what_is_there(spark):
    rows = [("a", "p", "1", "literal", None, None, None, 5), ("a", "p", "b", "iri", None, None, "g", 6)]
    new = [("a", "p", "1", "literal", None, None, None, 0), ("a", "p", "1", "literal", t.INTEGER, None, None, 1), ("c", "p", "b", "iri", None, None, None, 2),
           ("c", "p", "b", "iri", None, None, None, 3)]
    quads = spark.createDataFrame(rows, m.QUADS)
    out = up.insert_data(quads, spark.createDataFrame(new, m.QUADS))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows + [new[1], new[2]], key=str)
    again = up.insert_data(out, out.filter("s = 'c'").withColumn("g", F.lit("h")))
    assert again.count() == 5 and up.insert_data(quads, quads).count() == 2 and up.insert_data(quads, quads.limit(0)).count() == 2


def test_terms_match_by_prefix_and_spelling(spark):
    tokens = spark.createDataFrame([("app",), ("apple",), ("zzz",), ("",)], "token string")
    terms = spark.createDataFrame([("app",), ("apple",), ("applet",), ("ap",), ("aple",), ("x" * 3000,)], "term string")
    got = {(x["token"], x["term"], x["how"]) for x in se.match_terms(tokens, terms).collect()}
    assert got == {("app", "app", "exact"), ("app", "apple", "prefix"), ("app", "applet", "prefix"), ("apple", "apple", "exact"),
                   ("apple", "applet", "prefix"), ("apple", "aple", "fuzzy")}
