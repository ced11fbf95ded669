"""Benchmark decontamination by the q-gram lemma in diagonal bands.

Texts and items are reduced to their letters and digits, lower-cased, with one
blank between words.  Items are cut into overlapping windows.  An occurrence of
a window of length L with at most e edits shares at least L + 1 - q * (e + 1)
of its q-grams with the text, all within e + 1 neighbouring diagonals.  Hits
are counted in overlapping bands of diagonals; bands that reach the bound are
verified by an alignment restricted to the band.

Items are read in blocks of bounded size; every block is a stated query set
that goes to the tasks, and every text meets every block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quadrille.llm.common import by_text_id, col, pick

KEEP = re.compile(r"[\W_]+")
#: characters of items in one block
BLOCK_CHARS = 4_000_000


@dataclass(frozen=True)
class Search:
    """q: length of a q-gram.  window, step: length and distance of item
    windows; an item shorter than ``window`` is one window.  edit_percent: edit
    budget of a window.  shortest: items with fewer characters are not sought."""

    q: int = 12
    window: int = 120
    step: int = 60
    edit_percent: int = 5
    shortest: int = 40

    def budget(self, length: int) -> int:
        return length * self.edit_percent // 100

    def bound(self, length: int) -> int:
        return length + 1 - self.q * (self.budget(length) + 1)


def reduced(text: str | None) -> str:
    return KEEP.sub(" ", (text or "").lower()).strip()


def _grams(text: str, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams of a text, in order."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < q:
        return np.empty(0, np.uint64)
    c = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    c ^= c >> np.uint64(32)
    # q = a sum of powers of two; each part is a doubled polynomial hash
    out, done, part, size, base = None, 0, c, 1, np.array([0x8CB92BA72F3D8DD7], np.uint64)
    n = len(c) - q + 1
    while size <= q:
        if q & size:
            piece = part[done:done + n]
            out = piece.copy() if out is None else out * base + piece
            done += size
        if size * 2 <= q:
            part = part[:-size] * base + part[size:]
            base = base * base
        size *= 2
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _distinct_places(window: np.ndarray, band: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, band, number of its distinct places) of every pair that has hits."""
    low = band.min()
    bands, places = int(band.max() - low) + 1, int(place.max()) + 1
    if (int(window.max()) + 1) * bands * places >= 1 << 63:
        raise OverflowError("windows, bands and places of a text do not fit in one key")
    key = np.unique((window * bands + (band - low)) * places + place)
    pair, count = np.unique(key // places, return_counts=True)
    return pair // bands, pair % bands + low, count


class Block:
    """Item windows and their q-grams, sorted for look-up."""

    def __init__(self, items: list[tuple[int, str]], search: Search):
        self.search, self.windows = search, []      # (item, place in the item, text)
        for item, text in items:
            t = reduced(text)
            if len(t) < search.shortest:
                continue
            starts = list(range(0, max(1, len(t) - search.window + 1), search.step))
            if len(t) > search.window and starts[-1] + search.window < len(t):
                starts.append(len(t) - search.window)
            self.windows += [(item, s, t[s:s + search.window]) for s in starts]
        grams = [_grams(t, search.q) for _, _, t in self.windows]
        sizes = np.array([len(g) for g in grams], np.int64)
        keys = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if grams else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], owner[order], place[order]
        self.distinct = np.unique(keys)
        self.filter = np.zeros(1 << 20, bool)       # by the low bits, before the exact look-up
        self.filter[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.bounds = np.array([max(1, search.bound(len(t))) for _, _, t in self.windows], np.int64)
        self.least = int(self.bounds.min()) if len(self.bounds) else 0
        self.totals = Counter(item for item, _, _ in self.windows)
        self.width = 1 << max(1, search.budget(search.window)).bit_length()     # over the budget, so half a band holds it

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """(window, first diagonal of its band) of every band that meets the bound."""
        g = _grams(text, self.search.q)
        if len(g) < self.least or not len(self.keys):
            return []
        maybe = np.flatnonzero(self.filter[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.distinct, g[maybe])
        at[at == len(self.distinct)] = 0
        maybe = maybe[self.distinct[at] == g[maybe]]
        # a region of the text as long as a window and its budget must hold enough hits of any kind
        if len(maybe) < self.least:
            return []
        span = self.search.window + self.search.budget(self.search.window)
        ahead = np.searchsorted(maybe, maybe + span) - np.arange(len(maybe))
        dense = np.zeros(len(maybe) + 1, np.int64)
        start = np.flatnonzero(ahead >= self.least)
        np.add.at(dense, start, 1)
        np.add.at(dense, start + ahead[start], -1)
        maybe = maybe[np.cumsum(dense[:-1]) > 0]
        if not len(maybe):
            return []
        lo, hi = np.searchsorted(self.keys, g[maybe], "left"), np.searchsorted(self.keys, g[maybe], "right")
        n = hi - lo
        text_at = np.repeat(maybe, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        window, diagonal = self.owner[entry], text_at - self.place[entry] + self.search.window
        out = []
        for shift in (0, self.width):       # bands of twice the width that overlap by half
            band = (diagonal + shift) // (2 * self.width)
            # a q-gram of the window counts once in a band, however often the text repeats it
            w, b, count = _distinct_places(window, band, self.place[entry])
            good = count >= self.bounds[w]
            out += list(zip(w[good].tolist(), (b[good] * 2 * self.width - shift - self.search.window).tolist(), strict=True))
        return sorted(set(out))

    def edits(self, window: int, first: int, text: str) -> int | None:
        """Least edits of a window against a stretch of the text on diagonals
        ``first`` to ``first + 2 * width``; None if over the budget."""
        t = self.windows[window][2]
        budget, span = self.search.budget(len(t)), 2 * self.width + 1
        lo = first
        letters = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        stretch = np.full(len(t) + span, 0, np.uint32)
        s, e = max(0, lo), min(len(text), lo + len(stretch))
        if e <= s:
            return None
        stretch[s - lo:e - lo] = np.frombuffer(text[s:e].encode("utf-32-le"), np.uint32)
        steps = np.arange(span)
        row = np.zeros(span, np.int64)          # cells (i, i + lo + k); the match may begin on any diagonal
        for i, c in enumerate(letters):
            new = row + (stretch[i:i + span] != c)                  # keep or replace
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)            # a letter of the item is missing
            new = np.minimum.accumulate(new - steps) + steps        # further letters in the text
            row = new
            if row.min() > budget:
                return None
        least = int(row.min())
        return least if least <= budget else None

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, windows found, windows of the item, least edits) for a text."""
        t = reduced(text)
        found: dict[int, int] = {}
        for w, first in self.candidates(t):
            e = self.edits(w, first, t)
            if e is not None:
                found[w] = min(e, found.get(w, e))
        per: dict[int, list[int]] = {}
        for w, e in found.items():
            per.setdefault(self.windows[w][0], []).append(e)
        return [(item, len(v), self.totals[item], min(v)) for item, v in sorted(per.items())]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of bounded size, drawn one after the other."""
    block, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"] or ""))
        size += len(block[-1][1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, search: Search = Search(), doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_found,
    n_windows, edits (the least of a found window).

    A document holds an item when at least one window of it occurs within the
    edit budget, so a leaked part of ``window + step`` characters is enough.
    Null, empty and short texts and items match nothing; items without an id
    are skipped; items that share an id are one; equal rows of ``docs`` give
    equal rows.  Without items the result is empty.
    """
    d = pick(docs, doc_id=doc_id, text=text)
    known = pick(items, item_id=item_id, text=item_text).filter("item_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id string, item_id long, n_found long, n_windows long, edits long"
    out = None
    for entries in _blocks(known):
        block = Block(entries, search)

        def run(batches: Iterator[pd.DataFrame], block: Block = block) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(doc, *m) for doc, t in zip(pdf["doc_id"], pdf["text"], strict=True) for m in block.matches(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_found", "n_windows", "edits"])

        part = by_text_id(d, run, schema, "doc_id")
        out = part if out is None else out.union(part)
    return d.sparkSession.createDataFrame([], schema.replace("doc_id string", "doc_id long")) if out is None else out


def _clean(block: Block):
    @F.pandas_udf(T.BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([not block.matches(t) for t in texts], dtype=bool)
    return run


def keep_clean(docs: DataFrame, items: DataFrame, search: Search = Search(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns
    unchanged; the texts are judged in place, without a join."""
    own = docs.columns
    known = items.select(col("item_id").alias("item_id"), col("text").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    out = docs
    for entries in _blocks(known):
        block = Block(entries, search)
        out = out.filter(_clean(block)(col(text)))
    return out.select(*[col(c) for c in own])
