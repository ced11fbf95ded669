"""relatives are counted from bits of numbered ancestors; no pair of a node and an ancestor is listed."""

import random

from quadrille.operators import reachability, suggest as sg


def _closure(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = set()
    for a in up:
        todo, seen = [a], set()
        while todo:
            new = up.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out |= {(a, b) for b in seen}
    return out


def test_bits_hold_the_closure_also_on_cycles(spark):
    r = random.Random(7)
    edges = {(f"n{i:03}", f"n{r.randrange(max(1, i - 40), i + 1):03}") for i in range(1, 200) for _ in range(2)} | {("n010", "n190"), ("n003", "n003")}
    nodes, e = reachability.numbered(spark.createDataFrame(sorted(edges), "src string, dst string"))
    name = {x["id"]: x["node"] for x in nodes.collect()}
    assert sorted(name) == list(range(len({x for p in edges for x in p})))
    rows = reachability.listed(reachability.ancestor_bits(e)).collect()
    assert len(rows) == len(set(rows))
    assert {(name[x["src"]], name[x["dst"]]) for x in rows} == _closure(edges)


def test_many_below_the_same_ancestors_take_a_row_each(spark, monkeypatch):
    # 300 leaves below 5 nodes, each below 60 hubs under one top: 62 ancestors a leaf, of nodes that stand together
    edges = [(f"leaf{i}", f"m{i % 5}") for i in range(300)] + [(f"m{k}", f"h{j}") for k in range(5) for j in range(60)] + [(f"h{j}", "top") for j in range(60)]
    sizes, real = [], reachability.stored
    monkeypatch.setattr(reachability, "stored", lambda df: (sizes.append((out := real(df)).count()), out)[1])
    if hasattr(sg, "reach"):
        real_reach = sg.reach
        monkeypatch.setattr(sg, "reach", lambda *a, **k: (sizes.append((out := real_reach(*a, **k)).count()), out)[1])
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {(x["iri"], x["role"]): x["n"] for x in sg.context_counts(df, df.selectExpr("src AS iri")).collect()}
    assert got["leaf7", "ancestor"] == 62 and got["h3", "descendant"] == 305 and got["leaf7", "sibling"] == 59
    assert got["m1", "child"] == 60 and got["m1", "sibling"] == 4 and ("top", "descendant") not in got
    assert max(sizes) <= 2 * len({x for p in edges for x in p})      # the closure has 300 * 62 + 5 * 61 + 60 pairs
