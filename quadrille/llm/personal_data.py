"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans.  The field scores whole candidate segments
of up to LONGEST tokens with features of the span and its surroundings, and a
dynamic program chooses boundaries and kinds jointly.  It is trained here, by
an averaged structured perceptron, on a bounded sample whose labels are the
base spans and long hexadecimal secrets after ``=`` or ``:``.  Its spans are
added where they touch no base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.common import by_text_id, pick

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]

# fixed patterns
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# labels for training beside the base spans
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])")
SECRET_BEFORE = re.compile(r"[=:]\s*[\"']?$")

#: documents of at most SAMPLE_CHARS characters, at most SAMPLE_DOCS of them
SAMPLE_DOCS, SAMPLE_CHARS, EPOCHS = 500, 20_000, 6
#: tokens in a segment; tokens around a digit or @ in which segments are sought
LONGEST, AROUND = 12, 8
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
HOT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def octet(part: str) -> bool:
    """Whether digits, however many zeros lead them, are at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` takes the longest local part before it that no earlier match used."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if at > start and (m := EMAIL_DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, in code points, by start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if HOT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token lists around digits and ``@``; no segment crosses a line end or a gap of two blanks."""
    hot = [m.start() for m in HOT.finditer(text)]
    at = 0
    while at < len(hot):
        lo, hi = max(0, hot[at] - 80), hot[at] + 80
        while at < len(hot) and hot[at] - 80 <= hi:
            hi = hot[at] + 80
            at += 1
        while lo > 0 and not text[lo - 1].isspace():     # whole words
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        tokens = [m.span() for m in TOKEN.finditer(text, lo, min(hi, len(text)))]
        warm = [i for i, (s, e) in enumerate(tokens) if HOT.search(text, s, e)]
        keep = sorted({j for i in warm for j in range(max(0, i - AROUND), min(len(tokens), i + AROUND + 1))})
        run: list[tuple[int, int]] = []
        for i, j in enumerate(keep):
            broken = i > 0 and (j != keep[i - 1] + 1 or tokens[j][0] - tokens[j - 1][1] > 1 or "\n" in text[tokens[j - 1][1]:tokens[j][0]])
            if broken and run:
                yield run
                run = []
            run.append(tokens[j])
        if run:
            yield run


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def _class(c: str) -> str:
    return "e" if not c else "0" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


EMAIL_LIKE = re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")
IP_LIKE = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
HEX_LIKE = re.compile(r"[0-9A-Fa-f]+")


def features(text: str, start: int, end: int, n_tokens: int) -> list[str]:
    """Features of a whole span and its surroundings."""
    s = text[start:end]
    digits = "".join(c for c in s if c.isdigit() and c.isascii())
    letters = sum(map(str.isalpha, s))
    other = "".join(sorted({c for c in s if not c.isalnum()}))
    before, after = text[start - 1:start], text[end:end + 1]
    left = text[max(0, start - 16):start].rstrip(" \"'=:").rsplit(None, 1)
    shape = "mail" if EMAIL_LIKE.fullmatch(s) else "ip" if IP_LIKE.fullmatch(s) else "hex" if letters and digits and HEX_LIKE.fullmatch(s) else "digits" if not letters else "mixed"
    d = _bucket(len(digits), (1, 4, 10, 14, 16, 17, 20, 32))
    out = ["bias", f"shape={shape}", f"digits={d}", f"letters={_bucket(letters, (1, 4, 13))}", f"other={other[:6]}", f"tokens={_bucket(n_tokens, (2, 4, 7, 9, 12))}",
           f"shape,digits={shape},{d}", f"first={_class(s[0])}", f"last={_class(s[-1])}", f"before={_class(before)}", f"after={_class(after)}",
           f"shape,before={shape},{_class(before)}", f"shape,after={shape},{_class(after)}", f"left={left[-1].lower() if left else ''}"]
    if shape == "digits" and len(digits) >= 12:
        out.append(f"luhn={luhn(digits)},{d}")
    if shape == "ip":
        out.append(f"octets={all(map(octet, s.split('.')))}")
    return out


class Field:
    """Feature weights per kind, and the best segmentation under them."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = {} if weights is None else weights

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(first token, token after the last, kind) of the best segmentation.

        best[j] is the best score of the first j tokens; a token outside every
        segment scores zero, a segment of kind k the sum of its features.
        """
        n = len(tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        warm = np.cumsum([0] + [bool(HOT.search(text, s, e)) for s, e in tokens])
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i in range(max(0, j - LONGEST), j):
                if warm[j] == warm[i]:
                    continue
                score = np.zeros(len(KINDS))
                for f in features(text, tokens[i][0], tokens[j - 1][1], j - i):
                    if f in self.weights:
                        score += self.weights[f]
                k = int(score.argmax())
                if best[i] + score[k] > best[j] and score[k] > 0:
                    best[j], back[j] = best[i] + score[k], (i, k)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((i, j, k))
                j = i
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        if not self.weights:
            return []
        return [(tokens[i][0], KINDS[k], tokens[j - 1][1]) for tokens in regions(text) for i, j, k in self.segments(text, tokens)]


def labelled(text: str) -> list[tuple[int, str, int]]:
    """Base spans and secrets, without overlaps: the training labels."""
    spans = base_spans(text) + [(m.start(), "secret", m.end()) for m in SECRET.finditer(text) if SECRET_BEFORE.search(text, max(0, m.start() - 4), m.start())]
    out, end = [], -1
    for s, k, e in sorted(spans):
        if s >= end:
            out.append((s, k, e))
            end = e
    return out


def train(texts: list[str]) -> Field:
    """Averaged structured perceptron over the regions of ``texts``."""
    data = []
    for text in texts:
        gold = labelled(text)
        for tokens in regions(text):
            starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
            inside = [(starts[s], ends[e], KINDS.index(k)) for s, k, e in gold if s in starts and e in ends and ends[e] - starts[s] <= LONGEST]
            data.append((text, tokens, inside))
    now: dict[str, np.ndarray] = {}
    total: dict[str, np.ndarray] = {}
    field, step = Field(now), 1
    for _ in range(EPOCHS):
        for text, tokens, gold in data:
            got = field.segments(text, tokens) if now else []
            for sign, segments in ((1.0, set(gold) - set(got)), (-1.0, set(got) - set(gold))):
                for i, j, k in sorted(segments):
                    for f in features(text, tokens[i][0], tokens[j - 1][1], j - i):
                        now.setdefault(f, np.zeros(len(KINDS)))[k] += sign
                        total.setdefault(f, np.zeros(len(KINDS)))[k] += sign * step
            step += 1
    return Field({f: w - total[f] / step for f, w in now.items()})


def trained(docs: DataFrame) -> Field:
    """A field from a bounded sample of ``docs`` (doc_id, text) that hold a digit or ``@``."""
    hot = docs.filter((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    keys = hot.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"))
    share = min(1.0, 2.0 * SAMPLE_DOCS / max(1, keys.count()))
    near = hot.filter(F.xxhash64("doc_id") <= F.lit(min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))))
    rows = near.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(SAMPLE_DOCS).select("text").collect()
    return train([r["text"] for r in rows])


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def all_spans(text: str, base: list[tuple[int, str, int]], field: Field) -> list[tuple[int, str, int]]:
    """The base spans and those of the field that overlap none of them, by start, then kind."""
    taken = [(s, e) for s, _, e in base]
    new = [x for x in field.spans(text) if all(x[2] <= s or x[0] >= e for s, e in taken)] if HOT.search(text) else []
    return sorted(base + new, key=lambda x: (x[0], KINDS.index(x[1])))


def found(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base spans per kind,
    base_sha256, n_added and spans.

    Spans read ``kind:start:end`` in code points, end exclusive, by start, then
    kind.  Null and empty texts hold nothing.  ``field`` defaults to one trained
    on ``docs``; without a sample it adds nothing.
    """
    d = pick(docs, doc_id=doc_id, text=text)
    field = trained(d) if field is None else field
    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, n_added long, spans string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                t = t or ""
                base = base_spans(t)
                spans = all_spans(t, base, field)
                rows.append((key, *[sum(k == kind for _, k, _ in base) for kind in BASE_KINDS],
                             hashlib.sha256(_joined(base).encode()).hexdigest(), len(spans) - len(base), _joined(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "n_added", "spans"])

    return by_text_id(d, run, schema, "doc_id")
