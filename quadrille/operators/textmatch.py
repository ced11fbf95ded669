"""Dictionary matching over documents: concepts, phrases, spans, evidence.

Documents stay one row each.  A dictionary of at most HELD_ROWS entries and
HELD_CHARS characters goes to the tasks, which match each text in one pass.
Of a larger one, the distinct phrases and word sets of the documents are looked
up by equi-join; only what is found is regrouped, as a small dictionary per
document, and joined back to the text, where the choice among overlapping
matches is made.  No token is shuffled, and a Python worker holds one
document's tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quadrille import model as m
from quadrille.operators.paths import reach
from quadrille.session import cut, spread, stored

SPAN_DISTANCE = 4
ROW_BATCH = 10_000
#: a dictionary up to this size is held by every task
HELD_ROWS, HELD_CHARS = 100_000, 4_000_000
NAMING = [m.LABEL, m.SEE_ALSO, m.ALT]
TOKENS = T.StructType([
    T.StructField("line", T.ArrayType(T.IntegerType())), T.StructField("start", T.ArrayType(T.IntegerType())),
    T.StructField("end", T.ArrayType(T.IntegerType())), T.StructField("norm", T.ArrayType(T.StringType()))])

_SET = "\x1e"      # white space to the tokens, so in no word
_INT, _TEXT, _LIST = ("int", pa.int32()), ("string", pa.string()), ("array<string>", pa.list_(pa.string()))
_BREAKS = "\n\r\v\f\x85  "
_TOKEN = re.compile(rf"[{_BREAKS}]|\w+(?:['’ʼ‘`´]\w+)*|[^\w\s]")
_QUOTES = str.maketrans({c: "'" for c in "’ʼ‘`´"} | {c: '"' for c in "“”„«»"})


_NORMS: dict[str, str] = {}     # words seen by this process, NORMS_KEPT at most
NORMS_KEPT = 200_000


def _token_lists(text: str | None) -> tuple[list, list, list, list]:
    """Code point offsets of every word and punctuation mark, as parallel
    lists line, start, end, norm; Spark's regex functions return no positions."""
    lines, starts, ends, norms, line = [], [], [], [], 0
    for hit in _TOKEN.finditer(text or ""):
        word = hit.group()
        norm = _NORMS.get(word)
        if norm is None:
            norm = "" if word in _BREAKS else word.lower().translate(_QUOTES)
            if len(_NORMS) < NORMS_KEPT and len(word) < 100:
                _NORMS[word] = norm
        if not norm:
            line += 1
            continue
        start, end = hit.span()
        lines.append(line)
        starts.append(start)
        ends.append(end)
        norms.append(norm)
    return lines, starts, ends, norms


@F.pandas_udf(TOKENS)
def _tokens(texts: pd.Series) -> pd.DataFrame:
    """Tokens of short texts: names and slices, not documents."""
    return pd.DataFrame([_token_lists(t) for t in texts], columns=["line", "start", "end", "norm"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _norms(texts: pd.Series) -> pd.Series:
    return pd.Series([_token_lists(t)[3] for t in texts], dtype=object)


def tokenize(docs: DataFrame) -> DataFrame:
    """(doc_id, text), in enough tasks: each pass forms the tokens of a whole
    text where it needs them."""
    return spread(docs.select("doc_id", "text"))


def _each_document(docs: DataFrame, rows: Callable[..., Iterator[tuple]], fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``rows(...)`` of every document, called with the columns after doc_id.

    ``fields`` are name to Spark and Arrow type.  Documents are taken out of a
    batch one by one and rows leave in batches of ROW_BATCH.
    """
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *[f"`{n}` {kind}" for n, (kind, _) in fields.items()]])
    names, kinds = ["doc_id", *fields], [k for _, k in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns, out = batch.column(0), batch.columns[1:], []

            def made() -> pa.RecordBatch:
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), [ids.type, *kinds], strict=True)]
                return pa.RecordBatch.from_arrays(arrays, names)

            for i in range(batch.num_rows):
                key = ids[i].as_py()
                for row in rows(*[c[i].as_py() for c in columns]):
                    out.append((key, *row))
                    if len(out) >= ROW_BATCH:
                        yield made()
                        out.clear()
            if out:
                yield made()

    return docs.mapInArrow(run, schema)


# -- dictionary -------------------------------------------------------------

def canonical_id(iri: Column) -> Column:
    return F.lower(F.trim(F.substring_index(iri, "#", -1)))


def union_graph(quads: DataFrame) -> DataFrame:
    """The statements without their graphs, each once."""
    keys = [c for c in m.STATEMENT if c != "g"]
    return quads.groupBy(*keys).agg(F.min("pos").alias("pos")).withColumn("g", F.lit(None).cast("string")).select(*m.QUAD_COLS)


def _names(quads: DataFrame) -> DataFrame:
    inflected = F.substring_index("p", "#", -1) == "inflection"
    return quads.filter((F.col("p").isin(NAMING) | inflected) & ~m.is_bnode(F.col("s")))


def concepts(quads: DataFrame, kinds: DataFrame) -> DataFrame:
    """(canonical, iri, kind): entities with a naming statement; namespaces
    that share an identifier all stay."""
    named = _names(quads).select(F.col("s").alias("iri")).distinct()
    return named.join(kinds, "iri").select(canonical_id(F.col("iri")).alias("canonical"), "iri", "kind")


def dictionary(quads: DataFrame) -> DataFrame:
    """(canonical, alias): each literal is one whole alias."""
    rows = _names(quads).filter(m.is_literal()).select(canonical_id(F.col("s")).alias("canonical"), F.col("o").alias("alias"))
    return rows.distinct()


def phrases(aliases: DataFrame) -> DataFrame:
    """(key, length, canonical): aliases as token keys; the smallest canonical
    name wins a shared phrase.  ``a+b`` aliases are span rules instead."""
    rows = aliases.filter(~F.col("alias").contains("+")).select("canonical", _tokens("alias").alias("t"))
    keyed = rows.select("canonical", F.array_join("t.norm", " ").alias("key"), F.size("t.norm").alias("length"))
    return keyed.filter("length > 0").groupBy("key", "length").agg(F.min("canonical").alias("canonical"))


def span_rules(aliases: DataFrame) -> DataFrame:
    """(canonical, rule, words) from aliases such as ``alpha+beta``."""
    rows = aliases.filter(F.col("alias").contains("+"))
    words = F.array_distinct(F.filter(F.transform(F.split(F.lower("alias"), r"\+"), F.trim), lambda w: w != ""))
    return rows.select("canonical", F.lower("alias").alias("rule"), words.alias("words")).filter(F.size("words") > 1)


# -- phrase matching --------------------------------------------------------

class Lookup:
    """Phrases (key to canonical name) and rules (word set to canonical name
    and rule) that a text is matched against."""

    def __init__(self, names: dict[str, str], rules: dict[str, tuple[str, str]] | None = None):
        self.names, self.rules = names, rules or {}
        lengths: dict[str, set[int]] = {}
        for key in names:       # tokens hold no blanks
            lengths.setdefault(key.split(" ", 1)[0], set()).add(key.count(" ") + 1)
        self.lengths = {word: sorted(n) for word, n in lengths.items()}     # of the phrases that begin with a word
        self.sizes, self.near = set(), {}       # of word sets; words in a rule with a word
        for key in self.rules:
            size, *words = key.split(_SET)
            self.sizes.add(int(size))
            for word in words:
                self.near.setdefault(word, set()).update(words)
        self.sizes = sorted(self.sizes)


def _held(table: DataFrame, *columns: str) -> list[tuple] | None:
    """The rows of a stored dictionary table if every task can hold them, else None."""
    rows, chars = table.agg(F.count(F.lit(1)), F.sum(sum((F.length(c) for c in columns), F.lit(0)))).first()
    if rows > HELD_ROWS or (chars or 0) > HELD_CHARS:
        return None
    return [tuple(r) for r in table.select(*columns).collect()]


def _looked_up(docs: DataFrame, found: DataFrame, table: DataFrame) -> DataFrame:
    """``docs`` with what ``table(key, ...)`` holds for the keys ``found``
    ``(doc_id, key)`` in them, one list a column of ``table``; NULL if nothing."""
    known = found.join(table, "key").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct(*table.columns)).alias("_f"))
    lists = known.select("_id", *[F.col("_f")[c].alias(f"_{c}") for c in table.columns])
    return docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def _grams(text: str, lengths: list[int]) -> Iterator[tuple]:
    """The distinct runs of tokens inside a line, of some lengths."""
    lines, _, _, norms = _token_lists(text)
    seen = set()
    for i, line in enumerate(lines):
        for n in lengths:
            if i + n > len(lines) or lines[i + n - 1] != line:
                break
            seen.add(" ".join(norms[i:i + n]))
    return ((key,) for key in seen)


def _with_phrases(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, text, keys, names): the dictionary phrases that occur in each document;
    ``entries`` is a stored table."""
    lengths = sorted(r[0] for r in entries.select("length").distinct().collect())   # the few phrase lengths in use
    found = _each_document(docs, lambda text: _grams(text, lengths), {"key": _TEXT})
    return _looked_up(docs, found, entries.select("key", "canonical")).toDF("doc_id", "text", "keys", "names")


def _chosen(tokens: tuple, own: Lookup) -> list[tuple[int, int, str]]:
    """Phrases (first token, length, key), longest first, then leftmost, without overlap inside a line."""
    lines, _, _, norms = tokens
    hits = []
    for i, word in enumerate(norms):
        for n in own.lengths.get(word, ()):
            if i + n > len(lines) or lines[i + n - 1] != lines[i]:
                break
            key = word if n == 1 else " ".join(norms[i:i + n])
            if key in own.names:
                hits.append((-n, i, key))
    taken, kept = bytearray(len(lines)), []
    for n, i, key in sorted(hits):
        if 1 not in taken[i:i - n]:
            taken[i:i - n] = b"\1" * -n
            kept.append((i, -n, key))
    return kept


def match_exact(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """Phrase matches, longest first, without overlap inside a line:
    ``(doc_id, line, first, last, start, end, key, canonical)``."""
    entries = stored(entries)      # a table has a size, so the planner can broadcast a small one
    fields = {"line": _INT, "first": _INT, "last": _INT, "start": _INT, "end": _INT, "key": _TEXT, "canonical": _TEXT}

    def rows(text: str, own: Lookup) -> Iterator[tuple]:
        lines, starts, ends, _ = tokens = _token_lists(text)
        for i, n, key in _chosen(tokens, own):
            yield lines[i], i + 1, i + n, starts[i], ends[i + n - 1], key, own.names[key]

    held = _held(entries, "key", "canonical")
    if held is not None:
        whole = Lookup(dict(held))
        return _each_document(tokens, lambda text: rows(text, whole), fields)
    return _each_document(_with_phrases(tokens, entries).filter("keys IS NOT NULL"),
                          lambda text, keys, names: rows(text, Lookup(dict(zip(keys, names, strict=True)))), fields)


# -- spans ------------------------------------------------------------------
# A rule is met by an anchor and the words after it, so the sets of words that
# follow an anchor closely enough are looked up, not the rules of each word:
# a frequent word may be in any number of rules.

def _stream(tokens: tuple, chosen: list[tuple[int, int, str]], names: dict[str, str]) -> dict[int, list[tuple[int, int, str]]]:
    """Tokens after the exact swaps, per line: (start, end, norm); a swapped
    phrase is one token with its canonical name."""
    lines, starts, ends, norms = tokens
    swaps, out, i = {first: (n, key) for first, n, key in chosen}, {}, 0
    while i < len(lines):
        n, key = swaps.get(i, (1, None))
        out.setdefault(lines[i], []).append((starts[i], ends[i + n - 1], norms[i] if key is None else names[key]))
        i += n
    return out


def _windows(items: list[tuple[int, int, str]], sizes: list[int], distance: int, near: dict[str, set[str]] | None = None
             ) -> Iterator[tuple[str, list[int]]]:
    """Word sets of each anchor and of first sights of other words within
    ``distance`` places after it: (key of the set, places).  ``near`` are the
    words that can stand with a word; others are left out."""
    for a, (_, _, anchor) in enumerate(items):
        fits = None if near is None else near.get(anchor)
        if near is not None and fits is None:
            continue
        firsts, seen = [], {anchor}
        for b in range(a + 1, min(a + distance + 1, len(items))):
            word = items[b][2]
            if word not in seen and (fits is None or word in fits):
                seen.add(word)
                firsts.append(b)
        if firsts:
            for n in sizes:
                for others in combinations(firsts, n - 1):
                    places = [a, *others]
                    yield _SET.join([str(n), *sorted(items[b][2] for b in places)]), places


def _word_sets(rules: DataFrame, distance: int) -> DataFrame:
    """(key, n, canonical, rule): of several rules with the same words only the
    first can keep a place."""
    n = F.size("words")
    key = F.concat_ws(_SET, n.cast("string"), F.array_sort("words"))
    best = rules.filter(n <= distance + 1).groupBy(key.alias("key"), n.alias("n")).agg(F.min(F.struct("canonical", "rule")).alias("b"))
    return stored(best.select("key", "n", "b.canonical", "b.rule"))


def _with_rules(docs: DataFrame, best: DataFrame, distance: int) -> DataFrame:
    """Adds (sets, canonicals, rules): what ``_word_sets`` holds of the word sets
    that occur closely enough in a document."""
    sizes = sorted(r[0] for r in best.select("n").distinct().collect())     # at most distance

    def rows(text: str, keys: list[str] | None, names: list[str] | None) -> Iterator[tuple]:
        known = Lookup(dict(zip(keys or [], names or [], strict=True)))
        own = _token_lists(text)
        lines = _stream(own, _chosen(own, known), known.names)
        return ((key,) for key in {key for items in lines.values() for key, _ in _windows(items, sizes, distance)})

    out = _looked_up(docs, _each_document(docs, rows, {"key": _TEXT}), best.select("key", "canonical", "rule"))
    return out.toDF("doc_id", "text", "keys", "names", "sets", "canonicals", "rules")


def _line_spans(items: list, own: Lookup, distance: int) -> list[tuple]:
    """Spans (start, end, canonical, words) of one line: all words of a rule
    in any order within ``distance`` places; tightest first, without overlap."""
    found = []
    for key, places in _windows(items, own.sizes, distance, own.near):
        if key in own.rules:
            first, last = places[0], places[-1]
            found.append((last - first, first, last, items[first][0], items[last][1], *own.rules[key], [items[b][2] for b in places]))
    taken, kept = bytearray(len(items)), []
    for _, first, last, start, end, canonical, _, words in sorted(found):
        if 1 not in taken[first:last + 1]:
            taken[first:last + 1] = b"\1" * (last + 1 - first)
            kept.append((start, end, canonical, words))
    return sorted(kept)


def _nested(docs: DataFrame, aliases: DataFrame, distance: int, out: Callable, fields: dict) -> DataFrame:
    """``out(line, text, exact, spans)`` of every line with a match; ``exact``
    are (start, end, canonical, key), ``spans`` lie in order."""
    entries, sets = stored(phrases(aliases)), _word_sets(span_rules(aliases), distance)

    def rows(text: str, own: Lookup) -> Iterator[tuple]:
        lines, starts, ends, _ = tokens = _token_lists(text)
        chosen = _chosen(tokens, own)
        exact: dict[int, list] = {}
        for i, n, key in chosen:
            exact.setdefault(lines[i], []).append((starts[i], ends[i + n - 1], own.names[key], key))
        for line, items in _stream(tokens, chosen, own.names).items():
            yield from out(line, text, exact.get(line, []), _line_spans(items, own, distance) if own.rules else [])

    names = _held(entries, "key", "canonical")
    rules = None if names is None else _held(sets, "key", "canonical", "rule")
    if rules is not None:
        whole = Lookup(dict(names), {key: (canonical, rule) for key, canonical, rule in rules})
        return _each_document(docs, lambda text: rows(text, whole), fields)
    ready = _with_rules(_with_phrases(docs, entries), sets, distance)

    def found(text: str, keys: list | None, names: list | None, sets: list | None, canonicals: list | None, rules: list | None) -> Iterator[tuple]:
        known = dict(zip(keys or [], names or [], strict=True))
        return rows(text, Lookup(known, dict(zip(sets or [], zip(canonicals or [], rules or [], strict=True), strict=True))))

    return _each_document(ready.filter("keys IS NOT NULL OR sets IS NOT NULL"), found, fields)


def _around(start: int, end: int, spans: list[tuple], starts: list[int]) -> tuple | None:
    """The span that covers a place; spans of a line do not overlap."""
    at = bisect_right(starts, start) - 1
    return spans[at] if at >= 0 and end <= spans[at][1] else None


def match_nested(tokens: DataFrame, aliases: DataFrame, distance: int = SPAN_DISTANCE, slices: bool = False) -> DataFrame:
    """Exact phrases, then spans over the canonical stream; both methods in
    one table ``(doc_id, line, start, end, canonical, method, words)``, with
    ``slices`` also the ``slice`` of the text."""

    def out(line: int, text: str, exact: list, spans: list) -> Iterator[tuple]:
        at = [x[0] for x in spans]
        rows = [(a, b, name, "exact", key.split(" ")) for a, b, name, key in exact if not _around(a, b, spans, at)]  # else covered by it
        for a, b, name, method, words in rows + [(a, b, name, "spans", words) for a, b, name, words in spans]:
            yield line, a, b, name, method, words, *([text[a:b]] if slices else [])

    return _nested(tokens, aliases, distance, out, {
        "line": _INT, "start": _INT, "end": _INT, "canonical": _TEXT, "method": _TEXT, "words": _LIST, **({"slice": _TEXT} if slices else {})})


def covered_matches(tokens: DataFrame, aliases: DataFrame, distance: int = SPAN_DISTANCE) -> DataFrame:
    """(doc_id, start, end, covered): canonical names a span swallowed."""

    def out(line: int, text: str, exact: list, spans: list) -> Iterator[tuple]:
        at = [x[0] for x in spans]
        outer = ((_around(a, b, spans, at), name) for a, b, name, _ in exact)
        return iter({(span[0], span[1], name) for span, name in outer if span and name != span[2]})

    return _nested(tokens, aliases, distance, out, {"start": _INT, "end": _INT, "covered": _TEXT}).distinct()


# -- evidence ---------------------------------------------------------------

def span_offsets(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the matched slice of the text and whether it really holds the
    matched words; ordered by start, widest first."""
    rows, found = matches, _norms(F.col("slice"))
    if "slice" not in matches.columns:      # else the matches bring it along
        piece = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
        rows = matches.join(docs.select("doc_id", "text"), "doc_id").withColumn("slice", piece)
    rows = rows.withColumn("_found", found)
    sound = F.when(F.col("method") == "exact", F.col("_found") == F.col("words")).otherwise(F.size("_found") > 0)
    return rows.withColumn("sound", (F.col("start") < F.col("end")) & sound).drop("text", "_found")


def span_words(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Words a span used, only when a single rule explains it."""
    spans = matches.filter("method = 'spans'").select("doc_id", "start", "end", "canonical", F.array_sort("words").alias("w"))
    plain = rules.select("canonical", "rule", F.array_sort("words").alias("w"))
    fits = spans.join(plain, ["canonical", "w"])
    return fits.groupBy("doc_id", "start", "end", "canonical").agg(
        F.count(F.lit(1)).alias("n"), F.min("w").alias("words")).filter("n = 1").drop("n")


def text_graph(matches: DataFrame, entries: DataFrame, parents: DataFrame) -> DataFrame:
    """(doc_id, iri, matched): matched concepts of each document and all their
    ancestors.  ``entries(canonical, iri)``."""
    own = cut(matches.select("doc_id", "canonical").distinct().join(entries.select("canonical", "iri"), "canonical")
              .select("doc_id", "iri").distinct())
    up = reach(parents, own.select(F.col("iri").alias("start")).distinct()).select(F.col("start").alias("iri"), F.col("node").alias("up"))
    above = own.join(up, "iri").select("doc_id", F.col("up").alias("iri"), F.lit(False).alias("matched"))
    return own.withColumn("matched", F.lit(True)).unionByName(above).groupBy("doc_id", "iri").agg(F.max("matched").alias("matched"))
