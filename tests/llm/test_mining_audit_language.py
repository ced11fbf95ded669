"""Hard negatives, source divergence and language identification against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import divergence, hard_negatives as hn, language_gru as lg, personal_data
from quadrille.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# hard negatives

def plain_rows(rows, scale=256):
    out = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = (label, [float(np.floor(scale * x)) for x in e])
        out[i] = min(out.get(i, v), v)
    return out


def plain_mined(rows, anchor, positives=5, negatives=3):
    rows, out = plain_rows(rows), set()
    width = max((len(v) for _, v in rows.values()), default=0)
    full = {i: (label, [int(x) for x in v] + [0] * (width - len(v))) for i, (label, v) in rows.items()}
    for a, (label, v) in full.items():
        if not anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in full.items() if i != a)
        own = [(i, -s) for s, i in scores if full[i][0] == label][:positives]
        for p, ps in own:
            near = [(i, -s) for s, i in scores if full[i][0] != label and 50 * ps <= -100 * s <= 95 * ps][:negatives]
            out |= {(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(near)}
    return out


EMB = "vec_id long, embedding array<float>, label int, slot int, `a.b` int, tree int"


def embeddings(n, seed):
    r = np.random.default_rng(seed)
    base = r.standard_normal((12, 8))
    rows = []
    for i in range(n):
        x = base[i % 12] + 0.3 * r.standard_normal(8)
        rows.append((i, [float(np.float32(v)) for v in x / np.linalg.norm(x)], int(r.integers(4)), i, i, i))
    same = rows[5][1]
    rows += [(1000 + k, same, k % 2, 0, 0, 0) for k in range(40)]                   # a large group of one vector
    rows += [(7, rows[3][1], 2, 0, 0, 0), (7, rows[3][1], 2, 0, 0, 0)]              # repeated ids
    rows += [(None, same, 1, 0, 0, 0), (2000, None, 1, 0, 0, 0), (2001, same, None, 0, 0, 0), (2002, [1.0, None], 1, 0, 0, 0),
             (2003, [float("nan")] * 8, 1, 0, 0, 0), (2004, [float("inf")] * 8, 1, 0, 0, 0), (2010, [0.5, 0.5], 1, 0, 0, 0), (2020, [], 1, 0, 0, 0)]
    return rows


@pytest.mark.parametrize("mining", [hn.Mining(), hn.Mining(tree_size=7, block_rows=30)])
def test_hard_negatives_equal_brute_force(spark, mining):
    rows = embeddings(150, 4)
    df = spark.createDataFrame(rows, EMB)
    got = [tuple(r) for r in hn.mined(df, F.col("vec_id") % 10 == 0, mining).collect()]
    assert len(got) == len(set(got)) > 50
    assert set(got) == plain_mined([r[:3] for r in rows], lambda i: i % 10 == 0)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], EMB)
    assert hn.mined(empty, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame(embeddings(6, 1)[:1], EMB)
    assert hn.mined(one, F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_leave_out_most_scores_of_close_anchors():
    r = np.random.default_rng(2)
    x = np.floor(256 * (np.array([1.0] + [0.0] * 15) + 0.01 * r.standard_normal((60, 16))))
    order, parents, edges, depths = hn.spanning_tree(x)
    tree = hn.Side(np.arange(60), np.zeros(60, int), x[order], np.linalg.norm(x[order], axis=1))
    c = np.floor(256 * r.standard_normal((500, 16)))
    rows = hn.Side(np.arange(500), np.ones(500, int), c, np.linalg.norm(c, axis=1))
    exact, scored = tree.x @ c.T, 0
    low, high = 100_000, 110_000
    seen = np.zeros(exact.shape, bool)
    for at, score, mask in hn.scored(tree, parents, edges, depths, rows, lambda a, lo, hi: (hi >= low) & (lo <= high)):
        assert (score[mask] == exact[at][mask]).all()
        seen[at] |= mask
        scored += mask.sum()
    assert seen[(exact >= low) & (exact <= high)].all()
    assert scored < 0.5 * exact.size


def test_products_stay_exact_beyond_doubles():
    a, c = np.array([[2.0 ** 29 + 1, 3.0]]), np.array([[2.0 ** 29 + 3, 5.0]])
    assert hn.products(a, c, 2.0 ** 59)[0, 0] == (2 ** 29 + 1) * (2 ** 29 + 3) + 15
    with pytest.raises(OverflowError):
        hn.products(a * 2 ** 10, c * 2 ** 10, 2.0 ** 80)


# source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least, top=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        by = {s: collections.Counter() for s in {d[1] for d in mine}}
        for d in mine:
            by[d[1]].update(t for t in d[2] if seen[t] >= least)
        share = lambda c: (lambda used: {t: 1 + 10 ** 9 * (c[t] + 2) // (used + 2 * len(kept)) for t in kept})(sum(c.values()))
        p = {s: share(c) for s, c in by.items()}
        q = share(sum(by.values(), collections.Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in by if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            terms = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if by[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms)}
    return out


def audit_rows(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abéß中") for _ in range(r.randint(1, 3))) for _ in range(60)] + ["X", "x", "Zebra"]
    rows = []
    for k in range(160):
        source = "hot" if k % 3 else f"s{k % 11}"
        rows.append((" ".join(r.choice(vocab) + r.choice(["", ".", "9", "\n"]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), source))
    rows += [(None, "en", "empty"), ("", "fr", "a"), ("", "fr", "b"), ("one two", "it", None), ("a\x00b\x7fc É", "en", ""), ("x" * 5000 + " y", "en", "hot")]
    return rows + rows[:5]


@pytest.mark.parametrize("audit", [divergence.Audit(), divergence.Audit(digest_bits=4), divergence.Audit(bucket=8, block=2), divergence.Audit(least_docs=1000)])
def test_divergence_equals_counting(spark, audit):
    rows = audit_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, source string, part int, src int, `a.b` int").repartition(4)
    got = [tuple(r) for r in divergence.audited(df, audit).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, audit.least_docs)


def test_divergence_of_nothing(spark):
    assert divergence.audited(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_terms_are_cut_between_words(monkeypatch):
    text = ("Éa b c 7 " * 50 + "w" * 300 + "!").encode()
    monkeypatch.setattr(divergence, "PIECE", 64)
    got = [t.decode() for piece in divergence._terms(text) for t in piece]
    assert got == TERM.findall(text.decode().translate(LOWER))


# language identification

def test_gradients_agree_with_differences():
    net = lg.fresh(["a", "b", "c"], lg.Recipe(hidden=3))
    r = np.random.default_rng(0)
    x = lg.windows([bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (7, 3, 1, 7, 5)], 7)
    truth = np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(x, truth)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, sides = p[at], []
        for step in (1e-2, -1e-2):
            p[at] = kept + step
            sides.append(net.gradients(x, truth)[0])
        p[at] = kept
        assert abs((sides[0] - sides[1]) / 2e-2 - g[at]) < 2e-3


def test_padding_changes_nothing():
    net = lg.fresh(["a", "b"], lg.Recipe(hidden=4))
    alone = net.probabilities(lg.windows([b"hello"], 5)).reshape(2, 5, 1)
    padded = net.probabilities(lg.windows([b"hello", b"xyz"], 9)).reshape(2, 9, 2)[:, :5, :1]
    assert np.allclose(alone, padded, atol=1e-5)


def test_texts_are_read_whole(monkeypatch):
    net = lg.fresh(["a", "b"], lg.Recipe(hidden=4))
    text = bytes(random.Random(1).choices(range(256), k=1000))
    sums = []
    for abreast in (1, 3, 4096):
        monkeypatch.setattr(lg, "ABREAST", abreast)
        pool = lg.Pool(net, 64, 2)
        pool.add(0, b"other")
        pool.add(1, text)
        pool.flush()
        assert pool.labels[1].sum() == 1000
        sums.append(pool.sums[1])
    assert np.allclose(sums[0], sums[1], atol=1e-3) and np.allclose(sums[0], sums[2], atol=1e-3) and abs(sums[0].sum() - 1000) < 0.01


LANG = "doc_id long, text string, lang string, held_out int, `a.b` int, share double"


def test_language_of_odd_rows(spark):
    rows = [(k, "the cat and the dog " * 6, "en", 0, 0, 0.0) for k in range(40)] + [(100 + k, "für über das Wörterbuch nicht ß " * 4, "de", 0, 0, 0.0) for k in range(40)]
    odd = [(500, None, "en", 0, 0, 0.0), (501, "", "de", 0, 0, 0.0), (502, "12 34 ²", None, 0, 0, 0.0), (None, "the cat", None, 0, 0, 0.0), (2 ** 53 + 1, "the dog and the cat", None, 0, 0, 0.0),
           (503, "the " * 40_000, None, 0, 0, 0.0), (503, "über nicht das Wörterbuch", None, 0, 0, 0.0)]
    docs = spark.createDataFrame(rows + odd, LANG).repartition(2)
    net = lg.learned(docs, lg.Recipe(steps=40, batch=64))
    got = collections.defaultdict(list)
    for r in lg.predicted(docs, net).collect():
        got[r["doc_id"]].append(r)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    assert sum(map(len, got.values())) == len(rows) + len(odd)
    assert all(got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0 for i in (500, 501, 502))
    assert got[None][0]["lang_pred"] == got[2 ** 53 + 1][0]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in got[503]} == {"en", "de"}
    assert all(r["lang_pred"] == "de" for k in range(40) for r in got[100 + k])


def test_language_without_examples(spark):
    empty = spark.createDataFrame([], LANG)
    assert lg.learned(empty) is None and lg.predicted(empty, None).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None, 0, 0, 0.0)], LANG)
    assert lg.predicted(unlabelled, lg.learned(unlabelled)).first()["lang_pred"] == "und"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op13_byte_gru"](spark, SF).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9


def test_addresses_with_thousands_of_zeros():
    text = "0" * 5000 + ".1.2.3 and 256.1.1.1 and " + "9" * 5000 + ".1.2.3"
    assert personal_data.base_spans(text)[0] == (0, "ip", 5006)
    assert [k for _, k, _ in personal_data.base_spans(text)].count("ip") == 1
