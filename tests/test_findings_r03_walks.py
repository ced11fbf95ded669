"""Findings of round 3 on walks: nothing that grows with the input is broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import paths as pa, taxonomy as tax


def broadcasts(spark, run):
    """Broadcasts that Spark carried out while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()

    def ids():
        found = store.executionsList()
        return {found.apply(i).executionId() for i in range(found.size())}

    before, n = ids(), 0
    run()
    for one in ids() - before:
        nodes = store.planGraph(one).allNodes()
        n += sum(nodes.apply(i).name() == "BroadcastExchange" for i in range(nodes.size()))
    return n


def tree(spark, n=300):
    return spark.range(1, n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"),
                                    F.concat(F.lit("n"), F.expr("cast(id div 6 as string)")).alias("dst"))


@pytest.mark.parametrize("name", ["reach", "moves", "roots", "trail", "membership", "context"])
def test_walks_broadcast_nothing(spark, name):
    edges = tree(spark)
    some = edges.select(F.col("src").alias("iri"))
    run = {
        "reach": lambda: pa.reach(edges, some.select(F.col("iri").alias("start"))),
        "moves": lambda: tax.check_moves(edges, some, edges.select(F.col("dst").alias("iri"), F.col("src").alias("parent"))),
        "roots": lambda: tax.branch_roots(edges, some),
        "trail": lambda: tax.ancestry_trail(edges, some),
        "membership": lambda: pa.ancestor_membership(edges, some),
        "context": lambda: tax.class_context(edges, edges.select(F.col("src").alias("iri"), F.col("dst").alias("class")), "n1"),
    }[name]
    assert broadcasts(spark, lambda: run().collect()) == 0


def test_branch_roots_and_moves_equal_the_closure(spark):
    r = random.Random(3)
    for cyclic in (False, True):
        edges = {(f"n{i}", f"n{j}") for i in range(1, 40) for j in r.sample(range(i), min(i, r.randint(0, 2)))}
        if cyclic:
            edges |= {("n0", "n9"), ("n5", "n5"), ("n50", "n51"), ("n51", "n50"), ("n60", "n60"), ("n61", "n60")}
        up = {}
        for a in {x for e in edges for x in e}:
            todo, seen = [a], set()
            while todo:
                at = todo.pop()
                new = {d for s, d in edges if s == at} - seen
                seen |= new
                todo += new
            up[a] = seen
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        chosen = sorted(r.sample(sorted(up), len(up) // 3)) + ["alone"]
        chosen += [c for c in ("n50", "n60") if cyclic and c not in chosen]
        got = tax.branch_roots(df, spark.createDataFrame([(c,) for c in chosen], "iri string"))
        assert sorted(x["iri"] for x in got.collect()) == sorted(c for c in chosen if not (up.get(c, set()) - {c}) & set(chosen))
        moves = sorted({(r.choice(sorted(up)), r.choice(sorted(up))) for _ in range(200)})
        known = spark.createDataFrame([(c,) for c in up], "iri string")
        out = tax.check_moves(df, known, spark.createDataFrame(moves, "iri string, parent string")).collect()
        want = {(i, p): "own parent" if i == p else "below its descendant" if i in up[p] else None for i, p in moves}
        assert {(x["iri"], x["parent"]): x["issue"] for x in out} == want


def test_synonym_contexts_list_no_pairs_of_siblings(spark):
    from quadrille import model as m
    from quadrille.operators import suggest as sg
    r = random.Random(9)
    edges = {(f"n{i}", "hub") for i in range(1, 400)} | {(f"n{i}", f"n{i // 3}") for i in range(3, 400)} | {(f"n{i}", "hub2") for i in range(1, 30)}
    up = {}
    for a in {x for e in edges for x in e}:
        todo, seen = [a], set()
        while todo:
            at = todo.pop()
            new = {d for s, d in edges if s == at} - seen
            seen |= new
            todo += new
        up[a] = seen
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    noted = r.sample(range(1, 400), 60)
    quads = spark.createDataFrame([(f"n{i}", m.SEE_ALSO, "x") for i in noted], "s string, p string, o string")
    starts = sorted({s for s, _ in edges})
    got = {}
    for x in sg.synonym_context(df, quads, spark.createDataFrame([(s,) for s in starts], "iri string")).collect():
        assert x["relative"] not in got.setdefault((x["iri"], x["role"]), set())
        got[x["iri"], x["role"]].add(x["relative"])
    for s in starts:
        down = {a for a in up if s in up[a]}
        tops = {d for a, d in edges if a == s}
        beside = {a for a, d in edges if d in tops} - {s} - down - up[s]
        roles = {"ancestor": up[s], "descendant": down, "child": {a for a, d in edges if d == s}, "sibling": beside}
        for name, whole in roles.items():
            mine = got.get((s, name), set())
            assert mine <= whole and len(mine) == (len(whole) if name == "ancestor" else min(20, len(whole)))
        taken = set().union(*(got.get((s, name), set()) for name in ("child", "descendant", "sibling")))
        left = {f"n{i}" for i in noted} & (down | beside) - taken
        mine = got.get((s, "annotated"), set())
        assert mine <= left and len(mine) == min(20, len(left))
    # each start meets n siblings and as many more as it has lines, not all children of the hub
    pairs = df.select(F.col("src").alias("start"), F.col("dst").alias("p"))
    children = df.select(F.col("dst").alias("p"), F.col("src").alias("node"))
    lines = spark.createDataFrame([(a, b) for a in up for b in up[a]] + [(b, a) for a in up for b in up[a]], "start string, node string").distinct()
    assert sg._next_siblings(pairs, children, lines.limit(0), 5).count() <= 6 * len(edges)


def test_merge_compares_only_what_differs(monkeypatch):
    import difflib
    from quadrille.operators import merge as mg
    sizes, plain = [], difflib.SequenceMatcher

    def seen(junk, a, b, **more):
        sizes.append(len(a) + len(b))
        return plain(junk, a, b, **more)

    monkeypatch.setattr(mg.difflib, "SequenceMatcher", seen)
    text = "one two, three " * 200
    assert mg._merge_pieces(text, "A " + text, text + "B") == "A " + text + "B"
    assert mg._merge_pieces("a b c", "a x c", "a b c d") == "a x c d"
    assert max(sizes) <= 10
