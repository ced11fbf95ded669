"""Small fixtures written from the rules: edge cases that the tables lack."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quadrille import model as m
from quadrille.functions import terms as t, text as tx
from quadrille.operators import aggregates as ag, clusters as cl, entities as en, merge as mg, paths as pa, patterns as pt, search as se
from quadrille.operators import suggest as sg, taxonomy as tax, textmatch as tm, updates as up
from quadrille.session import global_index, group_index
from quadrille.sources import ntriples as nt
from quadrille.streaming import changes as ch

EX = "http://x.example/"


def quads(spark, rows):
    """rows of (s, p, o[, kind[, datatype[, lang[, g]]]]) with positions."""
    full = [(*r, *(("iri", None, None, None)[len(r) - 3:]), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, m.QUADS)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_term_comparison(spark):
    lit = t.literal
    r = one(spark,
            t.term_cmp(lit("1", t.INTEGER), "=", lit("1.0", t.DECIMAL)).alias("promoted"),
            t.term_cmp(lit("a"), "=", lit("a", t.STRING)).alias("plain"),
            t.term_cmp(lit("a", None, "en"), "=", lit("a")).alias("lang"),
            t.term_cmp(lit("a", None, "en"), "=", lit("a", None, "EN")).alias("case"),
            t.term_cmp(lit("x", EX + "t"), "=", lit("y", EX + "t")).alias("unknown"),
            t.term_cmp(lit("NaN", t.DOUBLE), "=", lit("NaN", t.DOUBLE)).alias("nan"),
            t.term_cmp(lit("a"), "<", lit("1", t.INTEGER)).alias("error"),
            t.term_cmp(lit("2020-01-01Z", t.DATE), "=", lit("2020-01-01", t.DATE)).alias("zone"),
            t.term_cmp(lit("2020-01-01Z", t.DATE), "=", lit("2020-01-03", t.DATE)).alias("far"),
            t.term_cmp(lit("2020-01-01T00:00:00Z", t.DATETIME), "=", lit("2020-01-01T01:00:00+01:00", t.DATETIME)).alias("instant"))
    assert (r.promoted, r.plain, r.lang, r.case) == (True, True, False, True)
    assert r.unknown is None and r.nan is False and r.error is None and r.zone is None
    assert r.far is False and r.instant is True


def test_arithmetic_and_casts(spark):
    lit = t.literal
    r = one(spark, t.arith(lit("1", t.INTEGER), "/", lit("4", t.INTEGER)).alias("q"),
            t.arith(lit("1", t.INTEGER), "/", lit("0", t.INTEGER)).alias("z"),
            t.arith(lit("1", t.INTEGER), "+", lit("x")).alias("e"),
            t.round_(lit("-2.5", t.DECIMAL)).alias("r"), t.cast(lit("3.9", t.DECIMAL), t.INTEGER).alias("i"),
            t.cast(lit("abc"), t.INTEGER).alias("bad"), t.cast(lit("true", t.BOOLEAN), t.DOUBLE).alias("b"),
            t.ebv(lit("abc", t.INTEGER)).alias("ill"), t.ebv(t.resource(F.lit(EX))).alias("iri"))
    assert r.q.value == "0.25" and r.q.datatype == t.DECIMAL and r.z is None and r.e is None
    assert r.r.value == "-2" and r.i.value == "3" and r.bad is None and float(r.b.value) == 1.0
    assert r.ill is False and r.iri is None


def test_text_helpers(spark):
    r = one(spark, tx.identifier_from_label(F.lit("R&D & x-ray HTTPServer")).alias("i"), tx.identifier_from_label(F.lit("!!")).alias("e"),
            tx.normalize_search(F.lit("Café BlueRing")).alias("n"), tx.is_placeholder(F.lit(EX + "New_Class-2")).alias("p"),
            tx.title_phrase(F.lit("the NASA guide TO r&d"), {"NASA": "NASA"}, ("the", "to")).alias("t"))
    assert r.i == "RDAndXRayHttpServer" and r.e == "Entity" and r.n == "cafe blue ring" and r.p
    assert r.t == "The NASA Guide to R&d"


def test_group_index_equals_window(spark):
    df = spark.createDataFrame([(k, v) for k in "aab" for v in range(50)], "k string, v int").dropDuplicates()
    got = {(r.k, r.v): r.item for r in group_index(df, ["k"], [F.col("v")]).collect()}
    assert got == {(k, v): v + 1 for k in "ab" for v in range(50)}
    rows = global_index(df.select("k", "v"), [F.col("k"), F.desc("v")], "i").collect()
    assert sorted(r.i for r in rows) == list(range(100))


def test_compatible_join_and_minus(spark):
    def sol(rows, *names):
        return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(
            *[t.literal(F.col(n)).alias(n) for n in names])
    a, b = sol([("1", "x"), ("2", None)], "k", "v"), sol([("1", "x"), ("1", None), ("2", "y"), ("1", "z")], "k", "v")
    got = sorted((r.k.value, r.v.value if r.v else None) for r in pt.join_compatible(a, b, ["v"]).collect())
    assert got == [("1", "x"), ("1", "x"), ("2", "y")]
    left = pt.minus(a, sol([("9", "x"), (None, None)], "k", "v"), ["k", "v"])
    assert sorted(r.k.value for r in left.collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        pt.natural_join(a.select("k"), b.select("v"))


def test_paths_against_brute_force(spark):
    rng = random.Random(7)
    edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    closure = set(edges)
    while True:
        more = closure | {(a, d) for a, b in closure for c, d in edges if b == c}
        if more == closure:
            break
        closure = more
    assert {tuple(r) for r in pa.plus(df).collect()} == closure
    assert {r.iri for r in tax.cyclic_nodes(df).collect()} == {a for a, b in closure if a == b}
    nodes = {x for e in edges for x in e}
    group = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert {r.node: r.component for r in tax.components(df).collect()} == group


def test_list_issues(spark):
    rows = []
    for name, cells in {"ok": 5, "long": 9}.items():
        for i in range(cells):
            rows.append((f"_:{name}{i}", m.FIRST, f"{EX}{name}{i}"))
            rows.append((f"_:{name}{i}", m.REST, m.NIL if i == cells - 1 else f"_:{name}{i + 1}", "iri" if i == cells - 1 else "bnode"))
    rows += [("_:c0", m.FIRST, EX + "c"), ("_:c0", m.REST, "_:c1", "bnode"), ("_:c1", m.FIRST, EX + "d"), ("_:c1", m.REST, "_:c0", "bnode"),
             ("_:b0", m.FIRST, EX + "b"), ("_:b0", m.REST, "_:gone", "bnode")]
    heads = spark.createDataFrame([("", h) for h in ("_:ok0", "_:long0", "_:c0", "_:b0")], "g string, head string")
    members, issues = en.rdf_lists(quads(spark, rows), heads, limit=8)
    assert {r["head"]: r.issue for r in issues.collect()} == {"_:long0": "limit", "_:c0": "cycle", "_:b0": "incomplete"}
    assert [r.member for r in members.orderBy("pos").collect()] == [f"{EX}ok{i}" for i in range(5)]


def test_density_links_equal_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.random() * 4, rng.random() * 4) for i in range(120)] + [(200 + i, 1.0, 1.0) for i in range(30)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    near = {(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 0.35}
    parent = {p[0]: p[0] for p in pts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in near:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {p[0]: root(p[0]) for p in pts}
    links = cl.near_links(df, 0.35)
    nodes = df.select(F.col("id").alias("node"))
    got = {r.node: r.component for r in tax.components(links, nodes).collect()}
    assert got == want
    cores = {r.id: (r.nearest, r.core) for r in cl.core_distances(df).collect()}
    for i, x, y in pts:
        ds = sorted(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for j, a, b in pts if j != i)
        assert cores[i] == pytest.approx((ds[0], ds[2]))


def test_carried_ids_are_greedy(spark):
    rng = random.Random(5)
    old = {i: rng.randrange(6) for i in range(60)}
    new = {i: rng.randrange(9) for i in range(70)}
    sizes = {c: sum(v == c for v in new.values()) for c in set(new.values())}
    shares = {}
    for i, c in new.items():
        if i in old:
            shares[(c, old[i])] = shares.get((c, old[i]), 0) + 1
    want, used = {}, set()
    for (c, p), n in sorted(shares.items(), key=lambda s: (-s[1], -sizes[s[0][0]], s[0][1], s[0][0])):
        if c not in want and p not in used:
            want[c] = p
            used.add(p)
    free = 0
    for c in sorted((c for c in sizes if c not in want), key=lambda c: (-sizes[c], min(i for i, v in new.items() if v == c))):
        while free in used:
            free += 1
        want[c] = free
        used.add(free)
    got = cl.carry_cluster_ids(spark.createDataFrame(list(old.items()), "id int, position long"),
                               spark.createDataFrame(list(new.items()), "id int, cluster long"))
    assert {r.cluster: r.position for r in got.collect()} == want


def test_minting_avoids_clashes(spark):
    names = spark.createDataFrame([(1, "red ring"), (2, "Red Ring"), (3, "red ring 2"), (4, "red ring")], "id long, label string")
    taken = spark.createDataFrame([(EX + "RedRing",), (EX + "RedRing3",)], "iri string")
    got = [r.iri for r in ag.mint_iris(names, taken, EX).collect()]
    assert len(set(got)) == 4 and not set(got) & {EX + "RedRing", EX + "RedRing3"}


def test_fuzzy_terms_equal_full_comparison(spark):
    rng = random.Random(11)
    vocab = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10))) for _ in range(120)}
    asked = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10))) for _ in range(25)}

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]
    want = set()
    for a, v in itertools.product(asked, vocab):
        k = 0 if len(a) < 4 else 1 if len(a) <= 7 else 2
        if v.startswith(a) or (k and dist(a, v) <= k):
            want.add((a, v))
    got = se.match_terms(spark.createDataFrame([(a,) for a in asked], "token string"), spark.createDataFrame([(v,) for v in vocab], "term string"))
    assert {(r.token, r.term) for r in got.collect()} == want


def test_contained_names_both_ways(spark, monkeypatch):
    rng = random.Random(2)
    names = {tuple(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(60)}

    def inside(p, w):
        it = iter(w)
        return all(x in it for x in p)
    want = {(w, p) for w in names for p in names if len(p) < len(w) and inside(p, w)}
    df = spark.createDataFrame([(list(n),) for n in names], "words array<string>")
    for limit in (10, 2):   # all by selections; long ones by their rarest word
        monkeypatch.setattr(sg, "SUBSET_WORDS", limit)
        assert {(tuple(r.words), tuple(r.part)) for r in sg.contained_names(df).collect()} == want


def test_text_matching(spark):
    docs = spark.createDataFrame([
        (1, "A kidney  injury blah acute, alpha b c beta\nbeta x alpha"), (2, "alpha one two three four beta; driver’s ed"),
        (3, "kidney\ninjury and Kidney Injury Unit")], "doc_id int, text string")
    aliases = spark.createDataFrame([
        ("renal", "kidney injury"), ("unit", "kidney injury unit"), ("ari", "renal+acute"), ("pair", "alpha+beta"), ("ed", "Driver's Ed")],
        "canonical string, alias string")
    found = tm.match_nested(tm.tokenize(docs), aliases)
    rows = tm.span_offsets(found, docs).collect()
    got = sorted((r.doc_id, r.canonical, r.method, r.slice) for r in rows)
    assert got == [(1, "ari", "spans", "kidney  injury blah acute"), (1, "pair", "spans", "alpha b c beta"), (1, "pair", "spans", "beta x alpha"),
                   (2, "ed", "exact", "driver’s ed"), (3, "unit", "exact", "Kidney Injury Unit")]
    assert all(r.sound for r in rows)
    inner = tm.covered_matches(tm.tokenize(docs), aliases).collect()
    assert [(r.doc_id, r.covered) for r in inner] == [(1, "renal")]


def test_merge_rules(spark):
    def v(*rows):
        return quads(spark, list(rows))
    base = v((EX + "a", m.COMMENT, "one two three", "literal"), (EX + "a", m.SUBCLASS, EX + "P"), (EX + "a", EX + "k", "1", "literal"))
    local = v((EX + "a", m.COMMENT, "ONE two three", "literal"), (EX + "a", m.SUBCLASS, EX + "Q"), (EX + "a", EX + "k", "1", "literal"))
    current = v((EX + "a", m.COMMENT, "one two THREE", "literal"), (EX + "a", m.SUBCLASS, EX + "P"), (EX + "a", EX + "k", "2", "literal"))
    merged, clash = mg.merge3(base, local, current)
    assert sorted((r.p, r.o) for r in merged.collect()) == sorted([(m.COMMENT, "ONE two THREE"), (m.SUBCLASS, EX + "Q"), (EX + "k", "2")])
    assert clash.isEmpty()
    same, none = mg.merge3(base, base, current)
    assert sorted(r.o for r in same.collect()) == sorted(r.o for r in current.collect()) and none.isEmpty()
    rival = v((EX + "a", m.COMMENT, "one two three", "literal"), (EX + "a", m.SUBCLASS, EX + "P"), (EX + "a", EX + "k", "3", "literal"))
    kept, conflict = mg.merge3(base, rival, current)
    assert [(r.s, r.p) for r in conflict.collect()] == [(EX + "a", EX + "k")]


def test_merge_keeps_edited_structure(spark):
    link, inner = (EX + "a", m.SUBCLASS, "_:r", "bnode"), ("_:r", m.OWL + "onProperty", EX + "p")
    changed = ("_:r", m.OWL + "onProperty", EX + "q")
    _, conflict = mg.merge3(quads(spark, [link, inner]), quads(spark, [inner]), quads(spark, [link, changed]))
    assert {(r.s, r.p) for r in conflict.collect()} == {(EX + "a", m.SUBCLASS)}


def test_nquads_escapes(spark):
    lines = [r'<http://x/a> <http://x/p> "tab\t quote\" back\\ é \U0001F600 it\'s"@en-GB <http://x/g> .', "# note", "",
             '_:b <http://x/p> "5"^^<http://x/int> . # tail "x"', "<< <http://x/a> <http://x/p> <http://x/b> >> <http://x/q> <http://x/c> .",
             '<http://x/a> <http://x/p> "open .', r'<http://x/a> <http://x/p> "ends in backslash \\" .']
    good, bad = nt.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = good.orderBy("pos").collect()
    assert rows[0].o == "tab\t quote\" back\\ é 😀 it's" and rows[0].o_lang == "en-GB" and rows[0].g == "http://x/g"
    assert rows[1].s == "_:b" and rows[1].o_datatype == "http://x/int" and rows[2].o == "ends in backslash \\"
    assert len(rows) == 3 and bad.count() == 2


def test_long_literal_does_not_overflow(spark):
    text = "line\\n" * 20000
    good, bad = nt.parse_lines(spark.createDataFrame([(f'<http://x/a> <http://x/p> "{text}" .',)], "value string"))
    assert good.select(F.length("o")).first()[0] == 5 * 20000 and bad.isEmpty()


def test_updates_and_changes(spark):
    q = quads(spark, [(EX + "a", EX + "p", "1", "literal"), (EX + "b", EX + "p", "2", "literal")])
    again = up.insert_data(q, q)
    assert again.count() == 2
    deltas = q.withColumn("op", F.lit("remove")).withColumn("seq", F.lit(1)).unionByName(
        q.filter("o = '1'").withColumn("op", F.lit("add")).withColumn("seq", F.lit(2)))
    assert [r.o for r in ch.apply_deltas(q, deltas).collect()] == ["1"]
    assert ch.subject_diff(q, q).isEmpty()


def test_construct_skips_bad_rows(spark):
    df = spark.range(2).select(t.literal(F.col("id").cast("string")).alias("x"), t.resource(F.when(F.col("id") == 0, EX + "s")).alias("y"))
    out = up.construct(df, [("?y", EX + "p", "?x"), ("?x", EX + "p", "?y"), ("_:n", EX + "q", "?x")])
    assert sorted((r.p, r.o) for r in out.collect()) == [(EX + "p", "0"), (EX + "q", "0"), (EX + "q", "1")]


def test_substrings_by_position(spark):
    s = t.literal("abcde")
    got = one(spark, *[t.substr(s, F.lit(a), F.lit(n)).alias(f"c{i}") for i, (a, n) in enumerate([(0, 3), (-1, 4), (2, 2), (4, 9), (9, 1), (1.5, 2.6)])],
              t.substr(s, F.lit(3)).alias("rest"))
    assert [got[f"c{i}"].value for i in range(6)] == ["ab", "ab", "bc", "de", "", "bcd"] and got.rest.value == "cde"


def test_exact_numbers(spark):
    big = "1234567890123456789012345"
    r = one(spark, t.term_cmp(t.literal(big, t.INTEGER), "=", t.literal(big[:-1] + "6", t.INTEGER)).alias("equal"),
            t.arith(t.literal(big, t.INTEGER), "+", t.literal("1", t.INTEGER)).alias("sum"),
            t.arith(t.literal("9" * 38, t.INTEGER), "*", t.literal("9" * 38, t.INTEGER)).alias("over"),
            t.arith(t.literal("1", t.INTEGER), "/", t.literal("3", t.INTEGER)).alias("third"))
    assert r.equal is False and r.sum.value == "1234567890123456789012346" and r.sum.datatype == t.INTEGER
    assert r.over is None and r.third.value == "0." + "3" * 18


def test_moments_without_zone(spark):
    def at(v):
        return t.literal(v, t.DATETIME)
    r = one(spark, t.term_cmp(at("2020-01-01T00:00:00"), "=", at("2020-01-01T00:00:00Z")).alias("open"),
            t.term_cmp(at("2020-01-01T00:00:00"), "<", at("2020-01-02T00:00:00Z")).alias("far"),
            t.term_cmp(at("2020-01-01T00:00:00"), "=", at("2020-01-01T00:00:00")).alias("both"))
    assert r.open is None and r.far is True and r.both is True


def test_relative_iris(spark):
    base = "http://a/b/c/d?q"
    r = one(spark, *[t.iri(t.literal(v), base).alias(f"c{i}") for i, v in enumerate(["../x", "g", "/g", "#s", "http://z/"])])
    assert [r[f"c{i}"].value for i in range(5)] == ["http://a/b/x", "http://a/b/c/g", "http://a/g", "http://a/b/c/d?q#s", "http://z/"]


def test_reader_keeps_tabs_and_escaped_iris(spark):
    lines = ['<http://a/\\u00e9> <http://p> "x\ty\\n" .', '<http://a/\\x> <http://p> "x" .']
    good, bad = nt.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    row = good.first()
    assert row.s == "http://a/é" and row.o == "x\ty\n" and bad.count() == 1


def test_composed_and_full_width_names(spark):
    r = one(spark, tx.name_key(F.lit("ＡＢ")).alias("k"), tx.identifier_from_label(F.lit("ﬁsh")).alias("i"),
            tx.text_distance(F.lit("caf\u00e9"), F.lit("cafe\u0301")).alias("d"))
    assert r.k == "ab" and r.i == "Fish" and r.d == 0


def test_redefined_conjunction_leaves_no_cells(spark):
    from quadrille.operators import edits as ed
    rows = [("c", k, EX + f"m{k}") for k in range(3)]
    frame = lambda r: spark.createDataFrame([(EX + a, b, c) for a, b, c in r], "iri string, position int, member string")
    first = ed.set_intersection(quads(spark, [("x", "y", "z")]), frame(rows))
    second = ed.set_intersection(first, frame(rows[:2]))
    assert first.count() == 1 + 8 and second.count() == 1 + 6
    assert second.filter(F.col("p") == m.REST).groupBy("s").count().filter("count > 1").isEmpty()


def test_comments_with_several_edits(spark):
    rows = [("one two three four", "ONE two three four", "one two three FOUR"), ("a b c d e", "a B c D e", "a b C d e"),
            ("a b", "a x", "a y"), ("a b", "a c", "a c"), ("a", None, "a")]
    df = spark.createDataFrame(rows, "base string, l string, r string")
    got = [x[0] for x in df.select(mg.merge_text("base", "l", "r")).collect()]
    assert got == ["ONE two three FOUR", "a B C D e", None, "a c", None]


@pytest.mark.parametrize("wide", [10, 2, 0])
def test_context_counts_equal_listed_relatives(spark, wide):
    r = random.Random(5)
    edges = {(f"n{i}", f"n{j}") for i in range(1, 60) for j in r.sample(range(i), min(i, r.randint(1, 4)))} | {("n0", "n7"), ("n3", "n3")}

    def reached(step):
        out = {}
        for a in {x for e in edges for x in e}:
            todo, seen = [a], set()
            while todo:
                new = step[todo.pop()] - seen
                seen |= new
                todo += new
            out[a] = seen - {a}
        return out
    up, down = ({x: {e[1 - k] for e in edges if e[k] == x} for e in edges for x in e} for k in (0, 1))
    above, below = reached(up), reached(down)
    want = {}
    for a in up:
        siblings = {b for p in up[a] for b in down[p]} - {a} - above[a] - below[a]
        for role, found in (("ancestor", above[a]), ("child", down[a] - {a}), ("descendant", below[a]), ("sibling", siblings)):
            if found:
                want[a, role] = len(found)
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = sg.context_counts(df, spark.createDataFrame([(x,) for x in up], "iri string"), wide)
    assert {(x["iri"], x["role"]): x["n"] for x in got.collect()} == want


@pytest.mark.parametrize("name", ["same_term_pair_counts", "compatible_join_counts"])
def test_pair_counts_of_whole_tables(spark, name):
    from oracle import compare, connect
    from quadrille.plans.catalogue import QUERIES
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), QUERIES[name], sf) is None
    n = {t: [r["k"] for r in spark.read.parquet(f"{sf}/{t}.parquet").select(F.col(f"{t[0]}_nationkey").alias("k")).collect()] for t in ("customer", "supplier")}
    assert name != "same_term_pair_counts" or sum(r["pairs"] for r in QUERIES[name].run(spark, sf).collect()) == sum(n["customer"].count(k) for k in n["supplier"])


@pytest.mark.parametrize("name", [f"{x}_of_all_words" for x in ("concept_dictionary", "graphless_union", "single_word_matches", "document_graphs")])
def test_queries_on_all_words(spark, name):
    from oracle import compare, connect
    from quadrille.plans.catalogue import QUERIES
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), QUERIES[name], sf) is None


def test_parents_of_names_of_any_length(spark):
    """All names of the tables against names and aliases of the catalogue."""
    from quadrille.plans.catalogue import QUERIES
    from quadrille.plans.registry import Source
    from quadrille.plans.search_queries import _classes
    sf = "/root/testdata/sf0.001"
    src = Source(spark, sf)
    classes = _classes(src)[0]
    label = {r["iri"]: r["label"] for r in classes.collect()}
    keys = {}
    names = [(r["s"], r["o"]) for r in src.quads("catalog").filter(F.col("p").isin(m.LABEL, m.SEE_ALSO, m.ALT) | F.col("p").endswith("#inflection")).filter(m.is_literal()).collect()]
    for iri, text in [*label.items(), *((s, o) for s, o in names if s in label and "+" not in o)]:
        keys.setdefault(" ".join(text.lower().split()), set()).add(iri)
    want = set()
    for name in set(label.values()):
        w = name.lower().split()
        whole, best = keys.get(" ".join(w), set()), {}
        for a, b in itertools.combinations(range(len(w) + 1), 2):
            for iri in keys.get(" ".join(w[a:b]), set()) - whole if b - a < len(w) else ():
                best[iri] = max(best.get(iri, (0, False, "")), (b - a, b == len(w), " ".join(w[a:b])))
        want |= {(name, iri, k) for iri, (_, _, k) in best.items()}
    got = QUERIES["parents_for_all_names"].run(spark, sf).collect()
    assert {(r["id"], r["iri"], r["matched"]) for r in got} == want and len(got) == len(want)
    assert any(r["matched"] not in label.values() for r in got)     # found by an alias
