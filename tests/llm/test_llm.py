"""The operators on small tables with every odd case, against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import (decontaminate, graph, host_reputation, html_text, mixing, near_dedup, personal_data, repetition,
                           suffix_dedup, token_output, warc_fixity)
from quadrille.llm.common import fresh_path
from quadrille.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _measured int, component int, u int, `a.b` int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def odd_rows():
    long = words(1, 6000)
    copy = words(2, 60)
    texts = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, copy), (6, copy), (7, copy + " tail"), (8, long), (9, words(3, 40)),
             (9, words(4, 40)), (None, copy), (None, None), (10, "mail a.b@c.example.org, +1 (017) 555-7713"), (10, "mail a.b@c.example.org, +1 (017) 555-7713"),
             (11, "x " * 30), (12, "é中\U0001f600 " + words(5, 30)), (13, "\x00\x1c\x85 <|endoftext|> \u2028")]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", None, k, k, k, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def found(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


# quality rules

def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(windows)
    inside = {i + k for i, g in enumerate(windows) if count[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_rep = len(inside)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_rep, len(w) < 10 or 100 * n_rep > 20 * len(w))


def test_quality_counts(docs, none):
    got = repetition.measured(docs)
    assert got.columns == [*docs.columns, "repetition"]
    for r in got.collect():
        m = r["repetition"]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed) == plain_quality(r["text"])
        assert not (m.kept and m.base_failed)
    assert repetition.keep_good(none).count() == 0
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns and found(kept, "doc_id")[(11,)] == 0 and found(kept, "doc_id")[(8,)] == 1


def test_ngram_coverage_of_each_length():
    w = words(7, 30).split()
    text = " ".join(w[:7] + w[7:20] + w[:7] + w[20:])
    got = repetition.measure(text, (5, 6, 7, 8))[-1]
    assert got == [2 * sum(map(len, w[:7]))] * 3 + [0]


# near-duplicates

def plain_classes(rows, n, percent=80):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        if i is not None and s:
            sets[i].append(s)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in sets}


def test_near_classes(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_classes(rows, 4)
    for r in near_dedup.classes(docs, near_dedup.Banding(words=4)).collect():
        assert r["component_id"] == (want.get(r["doc_id"], r["doc_id"]))
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    assert near_dedup.classes(none).count() == 0
    assert near_dedup.keep_first(docs).columns == docs.columns


def test_chains_and_large_groups(spark):
    """Texts that drift apart word by word: links only between neighbours, one class."""
    base = words(11, 80).split()
    rows = []
    for k in range(40):
        w = list(base)
        for j in range(k):
            w[(j * 7) % 80] = f"z{j}"
        rows.append((100 + k, " ".join(w)))
    rows += [(500 + k, words(50 + k, 30)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_classes(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(df, near_dedup.Banding(words=4)).collect()} == want


def test_minhash_estimates_similarity():
    flips, factors = near_dedup._seeds(192)
    x = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = x[:2700], x[300:]
    same = (near_dedup.minhashes(a, flips, factors) == near_dedup.minhashes(b, flips, factors)).mean()
    assert abs(same - 0.8) < 0.1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


# suffix arrays

def plain_removal(rows):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = [True] * 100
            seen.add(b[s:s + 100])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffix_removal(spark, none, monkeypatch):
    p, q = words(21, 40), words(22, 45)
    rows = [(1, p), (2, f"head {p} tail {q}"), (3, f"{q} {q} {q}"), (4, "z" * 400), (5, None), (6, ""), (7, "short"), (8, f"{p[:150]}!{p[150:]}"),
            (9, words(23, 3000) + p), (10, p), (11, "\x00" * 250 + "é" * 120), (12, "é" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r[n] for n in names) for r in suffix_dedup.deduplicated(df).collect()) == plain_removal(rows)
    assert suffix_dedup.deduplicated(none).count() == 0
    # anchors spread over several shards give the same result
    monkeypatch.setattr(suffix_dedup, "SHARD_ANCHORS", 1)
    assert sorted(tuple(r[n] for n in names) for r in suffix_dedup.deduplicated(df).collect()) == plain_removal(rows)


def test_repeated_ids_in_suffix_removal(docs):
    got = suffix_dedup.deduplicated(docs)
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and sum(r["n_removed"] for r in rows) > 0
    null_copy = [r for r in rows if r["doc_id"] is None and r["n_bytes"] > 0]
    assert null_copy[0]["n_removed"] == 0           # null ids come first


def test_suffix_order_and_prefixes():
    r = random.Random(3)
    for trial in range(20):
        text = bytes(r.choice(b"ab\x00") for _ in range(r.randint(100, 300))) * (1 + trial % 2)
        b = np.frombuffer(text, np.uint8)
        sa = suffix_dedup.suffix_array(b)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix_dedup.common_prefixes(b, sa, np.array([0]), np.array([len(b)]), 100)
        for k in range(1, len(sa)):
            x, y = text[sa[k - 1]:], text[sa[k]:]
            n = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
            assert lcp[k] == min(n, 100)


# decontamination

def test_leaks_with_edits(spark, docs, none):
    items = [(k, words(300 + k, 40)) for k in range(5)] + [(None, words(9, 40)), (7, None), (8, ""), (9, "too short")]
    item_df = spark.createDataFrame(items, "item_id long, text string")
    r, rows, want = random.Random(4), [], set()
    for k in range(5):
        s = list(items[k][1].upper())
        for _ in range(len(s) // 40):
            s[r.randrange(len(s))] = r.choice("XYZ")
        rows.append((k, words(400 + k, 200) + "\n" + "".join(s) + " " + words(500 + k, 50)))
        want.add((k, k))
    rows += [(20 + k, words(600 + k, 300)) for k in range(10)] + [(50, None), (51, ""), (None, items[0][1]), (52, items[1][1][:190])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.leaks(df, item_df)
    assert set(found(got, "doc_id", "item_id")) == want | {(None, 0), (52, 1)}
    assert decontaminate.leaks(none, item_df).count() == 0
    assert decontaminate.leaks(df, item_df.limit(0)).count() == 0
    clean = decontaminate.keep_clean(df, item_df)
    assert {r["doc_id"] for r in clean.collect()} == {*range(20, 30), 50, 51}
    assert decontaminate.keep_clean(docs, item_df).columns == docs.columns


def test_items_at_the_end_of_a_large_block():
    items = [(k, words(10_000 + k, 45)) for k in range(1800)]
    block = decontaminate.Block(items, decontaminate.Search())
    assert len(block.windows) > 5000
    for k in (0, 700, 1100, 1500, 1799):
        n = sum(1 for item, _, _ in block.windows if item == k)
        assert block.matches(words(1, 50) + " " + items[k][1] + " " + words(2, 50)) == [(k, n, n, 0)]


def test_banded_alignment_is_edit_distance():
    def distance(a, b):         # of a against any part of b
        row = [0] * (len(b) + 1)
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)
    r, item = random.Random(8), words(70, 24)[:120]
    block = decontaminate.Block([(1, item)], decontaminate.Search())
    for trial in range(60):
        s = list(item)
        for _ in range(trial % 12):
            k = r.randrange(len(s))
            s[k:k + 1] = r.choice([[], ["q"], [s[k], "w"]])
        text = decontaminate.reduced(words(trial, 5) + " " + "".join(s) + " " + words(trial + 1, 5))
        exact = distance(block.windows[0][2], text)
        got = block.matches(text)
        assert bool(got) == (exact <= block.search.budget(len(block.windows[0][2])))
        assert not got or got[0][3] == exact


# host reputation

def test_urls_and_rules(spark):
    urls = [("http://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
            ("http://a.com", "a.com", "", None, "allow"), ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"), ("nothing", "", "", None, "allow"),
            (None, "", "", None, "allow"), ("x://h.org#f/", "h.org", "", None, "allow"), ("ftp://b.com/q#z", "b.com", "/q", "com/", "allow"), ("http://com/", "com", "/", "com/", "allow"),
            ("http://xnet/es/", "xnet", "/es/", None, "allow")]
    pages = spark.createDataFrame([(k, u[0], 5) for k, u in enumerate(urls)] + [(None, "http://h.org/", 5)], "page_id long, url string, host int")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = host_reputation.judged(pages, none).collect()
    assert len(got) == 11
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["page_id"]][1:]


def test_posterior_shrinks(spark):
    rows, labels = [], []
    for k in range(200):
        bad_host = k % 10 == 0
        rows.append((k, f"http://{'bad' if bad_host else f'h{k % 20}'}.site{k % 4}.org/{k}"))
        labels.append((k, 1 if bad_host else 0))
    rows += [(900, "http://new.site0.org/"), (901, "http://one.site1.org/")]
    labels += [(901, 1), (901, 1), (None, 1), (5, None)]
    got = {r["page_id"]: r for r in host_reputation.judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow" and got[900]["verdict"] == "allow"
    assert got[0]["bound"] > got[901]["bound"]      # twenty outcomes weigh more than one


# mixing

def test_raking_meets_targets(spark, docs, none):
    r = random.Random(5)
    rows = [(k, words(k, r.randint(5, 40)), r.choice(["en", "en", "de"]), r.choice(["a", "a", "a", "b"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.4}}, budget=0.3)
    got = mixing.sampled(df, mix).select("mix.*").collect()
    total = sum(x.n_tokens for x in got)
    weight = lambda f: sum(x.n_tokens * x.probability for x in got if f(x)) / (0.3 * total)
    assert abs(weight(lambda x: True) - 1) < 1e-6 and abs(weight(lambda x: x.source == "a") - 0.5) < 1e-3 and abs(weight(lambda x: x.lang == "de") - 0.4) < 1e-3
    kept = sum(x.n_tokens for x in got if x.kept)
    assert abs(kept / total - 0.3) < 0.03
    assert mixing.sampled(none).count() == 0
    assert mixing.sampled(docs).count() == docs.count() and mixing.keep_sampled(docs).columns == docs.columns


def test_many_cells_take_the_shuffled_way(spark, monkeypatch):
    cells = spark.createDataFrame([(f"s{k % 7}", f"l{k % 3}", None if k % 2 else "t", 10 + k * k % 91) for k in range(42)], "source string, lang string, topic string, tokens long")
    few = {tuple(r[:3]): r["probability"] for r in mixing.weighted_cells(cells, mixing.Mix(rounds=2)).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 3)
    many = {tuple(r[:3]): r["probability"] for r in mixing.weighted_cells(cells, mixing.Mix(rounds=2)).select("source", "lang", "topic", "probability").collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few)


# token output

def test_token_round_trip(spark, docs, none):
    path = fresh_path(spark, "test-ids")
    token_output.write(docs, path, TOKENIZER)
    plain = token_output.Encoder(TOKENIZER).tokenizer
    ids = {}
    for i, t in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        ids.setdefault(i, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 2])
    got = token_output.documents(spark, path).collect()
    assert len(got) == docs.count() and all(list(r["ids"]) in ids[r["doc_id"]] for r in got)
    rows = sorted(token_output.summary(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    keys = [r["doc_id"] for r in rows]
    assert [k for k in keys if k is not None] == sorted(k for k in keys if k is not None)
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r["doc_id"]]}
    assert [list(r["ids"]) for r in token_output.documents(spark, path, [8]).collect()] == ids[8]
    empty = fresh_path(spark, "test-ids")
    token_output.write(none, empty, TOKENIZER)
    assert token_output.summary(spark, empty).count() == 0


def test_encoder_is_exact():
    e, r = token_output.Encoder(TOKENIZER), random.Random(6)
    letters = list(" \n\t\r\x0b\xa0\u3000ab'sdlT1२½中🙂!?#_-.é\u200b")
    for _ in range(4000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 16)))
        assert np.frombuffer(e.encode(s), "<u2").tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids


def test_dictionary_is_used_and_checked(spark):
    path = fresh_path(spark, "test-ids")
    spark_docs = spark.createDataFrame([(k, words(k % 40, 120)) for k in range(300)], "doc_id long, text string")
    token_output.write(spark_docs, path, TOKENIZER)
    name, data = token_output.read_dictionary(spark, path)
    assert data and name == hashlib.sha256(data).hexdigest()
    assert {r[0] for r in spark.read.parquet(path).select("dictionary").collect()} == {name}


# personal data

def test_base_spans():
    t = "a@b.c a@b x@y.z@q.w; +1 (017) 555-7713; 1.2.3.4; 1.2.3.999; 4111 1111 1111 1111; 4111111111111112; 01.02.003.0255"
    got = personal_data.base_spans(t)
    assert [(k, t[s:e]) for s, k, e in got] == [("email", "a@b.c"), ("email", "x@y.z"), ("phone", "+1 (017) 555-7713"), ("ip", "1.2.3.4"),
                                               ("card", "4111 1111 1111 1111"), ("ip", "01.02.003.0255")]
    assert personal_data.base_spans("+1 (017) 555-7713 1.2.3.4 5")[0][1] == "ip"      # the run of digits is too long for a phone


def test_base_spans_equal_plain_patterns():
    r = random.Random(9)
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(20000):
        s = "".join(r.choice("ab1.@-% 2+") for _ in range(r.randint(0, 22)))
        assert [m.span() for m in plain.finditer(s)] == list(personal_data._emails(s))


def test_field_learns_and_adds(spark, docs, none):
    r = random.Random(10)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(80)]
    texts = [f"{words(k, 6)} token = \"{h}\" {words(k + 1, 5)} version {k}." for k, h in enumerate(hexes)]
    texts += [f"{words(k, 4)} {k}@mail{k % 9}.example.com {words(k, 3)} 10.{k}.3.4 {words(k, 3)} +1 (0{k % 90 + 10}) 555-{1000 + k}" for k in range(80)]
    field = personal_data.train([t for k, t in enumerate(texts) if k % 4])
    held = [t for k, t in enumerate(texts) if k % 4 == 0]
    hits = sum(len(set(field.spans(t)) & set(personal_data.labelled(t))) for t in held)
    assert hits >= 0.95 * sum(len(personal_data.labelled(t)) for t in held) and hits >= 0.95 * sum(len(field.spans(t)) for t in held)
    got = personal_data.found(docs, field)
    assert got.count() == docs.count() and found(got.filter("n_email = 1 AND n_phone = 1"), "doc_id") == {(10,): 2}
    nothing = hashlib.sha256(b"").hexdigest()
    assert {(x["spans"], x["base_sha256"]) for x in got.filter("doc_id IN (1, 2, 3)").collect()} == {("", nothing)}
    assert personal_data.found(none).count() == 0


# HTML

def test_main_text(spark):
    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy this now, it is a long advert text.</div>"
            "<article><h1>Head &amp; line</h1><p><b>First&nbsp; one<br>more.<p>Second\n  <a href=y>link</a> text &eacute;.</p><p>S.</p><form>Name <input></form>"
            "<div class='comments'><p>A reader says something long about it.</p></div></article><aside>Side</aside><footer>&copy; me</footer></body></html>")
    assert html_text.main_text(page) == "Head & line\nFirst one more.\nSecond link text é.\nS."
    assert html_text.main_text("<div>" + "Long text in a plain container. " * 9 + "</div><div><a>x</a><a>y</a></div>").startswith("Long text")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "plain"), (5, "u", "<nav>only</nav>"), (1, "u", page), (6, "u", "<article></article>")]
    got = html_text.extracted(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"))
    assert found(got, "page_id", "n_chars") == {(1, 50): 2, (2, 0): 1, (3, 0): 1, (None, 5): 1, (5, 0): 1, (6, 0): 1}
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_several_regions():
    def p(seed, n=40):
        return f"<p>{words(seed, n)}</p>"
    lists = "<div>" + "<a href=x>page</a> " * 12 + "</div>"
    two = f"<body>{lists}<article>{p(1, 90)}{p(2, 80)}</article>{lists}<article>{p(3, 50)}{p(4, 30)}</article></body>"
    assert html_text.main_text(two).split("\n") == [words(1, 90), words(2, 80), words(3, 50), words(4, 30)]
    texts = [words(20 + k, 60 - 5 * k) for k in range(4)]
    siblings = f"<body>{lists}<div>" + "".join(f"<div><p>{t}</p></div>" for t in texts) + f"</div>{lists}</body>"
    assert html_text.main_text(siblings).split("\n") == texts
    between = f"<body>{lists}<div>{p(5)}{p(6)}</div><div>Yes.</div><div>{p(7)}{p(8)}</div></body>"
    assert html_text.main_text(between).split("\n") == [words(5, 40), words(6, 40), "Yes.", words(7, 40), words(8, 40)]
    inner = f"<main><h1>Head</h1><section>{p(9)}</section>{lists}<section>{p(10)}</section></main>"
    assert html_text.main_text(inner).split("\n") == ["Head", words(9, 40), words(10, 40)]
    outside = f"<body><article><p>Short.</p></article>{lists * 8}<div>{p(11)}{p(12)}{p(13)}</div></body>"
    assert html_text.main_text(outside).split("\n") == [words(11, 40), words(12, 40), words(13, 40)]
    assert html_text.main_text("<div><a>only</a></div><div><a>links</a></div>") == "only\nlinks"


def test_threshold_and_smoothing():
    v = np.array([1.0, 1.0, 10.0, 10.0])
    assert html_text.threshold(v) == 5.5 and np.allclose(html_text.smoothed(np.ones(9), 1.0), 1)


# fixity

def test_audit_finds_every_difference(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", words(k, 200)) for k in range(400)] + [(None, None, None), (7, "http://h/7", "again")], "page_id long, url string, html string")
    first = warc_fixity.manifest(warc_fixity.records(pages, pages_per_file=64))
    second = (first.filter("page_id IS NULL OR page_id <> 70").withColumn("sha256", F.when(F.col("page_id").isin(3, 200), F.lit("0")).otherwise(F.col("sha256")))
              .union(first.filter("page_id = 9").withColumn("record_offset", F.lit(10 ** 7).cast("long"))))
    got = warc_fixity.located(warc_fixity.audit(first, second), first)
    assert found(got, "page_id", "status") == {(3, "changed"): 1, (200, "changed"): 1, (70, "missing"): 1, (None, "extra"): 1}
    assert warc_fixity.audit(first, first).count() == 0
    assert warc_fixity.audit(first.limit(0), first.limit(0)).count() == 0
    assert warc_fixity.audit(first, first.limit(0)).count() == 402


# registered queries

@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    from oracle import connect, rows_of
    df = QUERIES[name](spark, SF)
    result = connect(SF).execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_suffix_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = QUERIES["op4_suffix_arrays"](spark, SF).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_removal(rows)


def test_extraction_query_finds_the_article(spark):
    """The paragraphs of a page's article are the text of the document its path names."""
    docs = {r["doc_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_html_extraction"](spark, SF).collect():
        number = int(re.search(r"/(\d+)", r["url"].split("example", 1)[1])[1])
        assert " ".join(r["text"].split("\n", 1)[1].split()) == docs[number]


def test_pipeline_equals_plain_stages(spark):
    documents = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    kept = [i for i, r in documents.items() if (m := repetition.measure(r["text"], (5, 6, 7, 8, 9, 10))) and not plain_quality(r["text"])[-1]
            and 100 * m[6] <= 30 * m[5] and 100 * m[2] <= 30 * m[0] and all(100 * c <= 20 * m[1] for c in m[7])]
    classes = plain_classes([(i, documents[i]["text"]) for i in kept], 5)
    kept = [i for i in kept if classes.get(i, i) == i]
    items = [decontaminate.reduced(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [i for i in kept if not any(t in decontaminate.reduced(documents[i]["text"]) for t in items)]
    assert set(got) <= set(kept) and len(got) >= 0.5 * len(kept)
    plain = token_output.Encoder(TOKENIZER).tokenizer
    assert all(n == len(plain.encode(documents[i]["text"], add_special_tokens=False).ids) + 1 for i, n in got.items())
