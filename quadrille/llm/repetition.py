"""Quality rules by repetition coverage.

Words are runs of characters other than blank, tab and line breaks.  Rolling
hashes of several n-gram lengths give, per length, the characters inside
n-grams that occur more than once in the text; equal lines give the characters
inside repeated lines.  A text is judged by the shares of its characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quadrille.llm.common import col

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
BASE_LENGTH = 5
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 10, 20


@dataclass(frozen=True)
class Rules:
    """Largest allowed percentages; a text above one of them is rejected.

    ngram_percent: per n-gram length, of the word characters that lie in
    n-grams found more than once.  line_percent: of the characters in lines
    with a word that repeat an earlier line.  symbol_percent: symbols
    ``#*$%&|<>`` per hundred words.
    """

    ngram_percent: tuple[tuple[int, int], ...] = ((5, 20), (6, 20), (7, 20), (8, 20), (9, 20), (10, 20))
    line_percent: int = 30
    symbol_percent: int = 30


DEFAULT = Rules()

FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
          ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
          ("line_chars", T.LongType()), ("dup_line_chars", T.LongType()),
          ("ngram_chars", T.ArrayType(T.LongType()))]


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit scramble of small integers."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _covered(windows: np.ndarray, length: int, n_words: int) -> np.ndarray | None:
    """Which words lie in a window whose hash occurs more than once; None if none does."""
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    starts = np.flatnonzero(np.isin(windows, twice))
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, lengths: tuple[int, ...]) -> tuple:
    """The values of FIELDS for one text; all zero for null and empty texts."""
    text = text or ""
    words = WORD.findall(text)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    repeat_words, chars = 0, {}
    rolled, hashes, step = _mixed(ids), _mixed(ids), np.uint64(0x8CB92BA72F3D8DD7)
    anything = True     # a repeated longer n-gram holds a repeated shorter one
    for n in range(2, max(*lengths, BASE_LENGTH) + 1):
        if len(words) < n:
            break
        rolled = rolled[:-1] * step + hashes[n - 1:]
        if anything and (n in lengths or n == BASE_LENGTH):
            mask = _covered(rolled, n, len(words))
            anything = mask is not None
            if anything:
                chars[n] = int(sizes[mask].sum())
                repeat_words = int(mask.sum()) if n == BASE_LENGTH else repeat_words
    seen: set[str] = set()
    dup_lines = line_chars = dup_chars = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            seen.add(line)
    symbols = len(NOT_SYMBOL.sub("", text))
    return (len(words), int(sizes.sum()), symbols, dup_lines, repeat_words, line_chars, dup_chars,
            [chars.get(n, 0) for n in lengths])


def measured(docs: DataFrame, text: str = "text", rules: Rules = DEFAULT, into: str = "repetition") -> DataFrame:
    """``docs`` with a struct column ``into``: the counts of FIELDS and the two verdicts.

    base_failed: fewer than 10 words, or over 20 % of the words in five-word
    windows found twice.  kept: not base_failed and within all ``rules``.
    Null and empty texts have no words and fail.  Rows, ties and other columns
    stay as they are; a column called ``into`` is replaced.
    """
    lengths = tuple(n for n, _ in rules.ngram_percent)
    schema = T.StructType([T.StructField(n, t) for n, t in FIELDS])

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, lengths) for t in texts], columns=[n for n, _ in FIELDS])

    m = F.col("measured")
    base_failed = (m.n_words < BASE_MIN_WORDS) | (100 * m.n_repeat_words > BASE_REPEAT_PERCENT * m.n_words)
    within = (100 * m.dup_line_chars <= rules.line_percent * m.line_chars) & (100 * m.n_symbols <= rules.symbol_percent * m.n_words)
    for i, (_, percent) in enumerate(rules.ngram_percent):
        within = within & (100 * m.ngram_chars[i] <= percent * m.word_chars)
    own = [c for c in docs.columns if c != into]
    out = docs.select(F.struct(*[col(c) for c in own]).alias("row"), run(col(text)).alias("measured"))
    fields = [m[n].alias(n) for n, _ in FIELDS]
    return out.select(*[F.col("row")[c].alias(c) for c in own],
                      F.struct(*fields, base_failed.alias("base_failed"), (~base_failed & within).alias("kept")).alias(into))


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged."""
    own = docs.columns
    out = measured(docs, text, rules, into="__repetition")
    return out.filter(F.col("__repetition.kept")).select(*[col(c) for c in own])
