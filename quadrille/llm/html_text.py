"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams a page as events; every block-level
boundary ends a line.  A line's ratio is its characters over the tags that it
took.  Ratios are smoothed with a Gaussian along the page and split into two
clusters by an iterated threshold; every container with a line of the upper
cluster is content, and all of its lines are kept.  Containers between content
containers, or in one article or main with them, belong to the content too.
Containers that are boilerplate by element or by name never contribute, and
those of mostly link text only if the page has nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrille.llm.common import by_text_id, pick

# fixed values: elements by their role in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
                  "table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head iframe input label map menu nav noembed noframes "
                     "noscript object script search select style svg template textarea title video".split())
HEADERS = frozenset(["header", "hgroup"])
REGIONS = frozenset(["article", "main"])
CONTAINERS = frozenset(["article", "main", "section", "div", "body", "td", "center"])
#: words in class, id or role that mark boilerplate
LEFT_OUT_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements adsbygoogle banner breadcrumb breadcrumbs comment comments commentary consent "
                           "contentinfo cookie cookies disqus dropdown footer form login menu modal nav navbar navigation newsletter notice notices "
                           "overlay pagination popup promo promoted promotion related respond share sharing sidebar signup social sponsor sponsored "
                           "subscribe teaser toolbar widget".split())
NAME_WORD = re.compile(r"[a-z]+")
FEED = 1 << 16


@dataclass
class Line:
    text: str
    tags: int
    container: int      # number of the nearest container element
    region: int         # number of the outermost article or main around it, or -1
    linked: int         # characters of it in links


class Events(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []      # element, left out, container, region
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.elements = self.linked = 0
        self.parents: dict[int, int] = {}       # of a container: the one around it

    def _top(self) -> tuple[str, bool, int, int]:
        return self.open[-1] if self.open else ("", False, 0, -1)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            _, _, container, region = self._top()
            self.lines.append(Line(text, self.tags, container, region, self.linked))
            self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in ("br", "hr"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "p":          # a paragraph ends the one before it in the same container
            self._close("p", within=CONTAINERS | {"li", "blockquote", "aside"})
        if tag in REGIONS:      # what should have been closed before it
            while self.open and self.open[-1][1] and self.open[-1][0] not in REGIONS:
                self.open.pop()
        self.elements += 1
        _, out, container, region = self._top()
        names = {w for k, v in attrs if k in ("class", "id", "role") and v for w in NAME_WORD.findall(v.lower())}
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        out = out or tag in LEFT_OUT or hidden or (tag in HEADERS and region < 0) or (tag not in ("html", "body") and bool(names & LEFT_OUT_NAMES))
        if tag in CONTAINERS:
            self.parents[self.elements] = container
            container = self.elements
        if tag in REGIONS and region < 0 and not out:
            region = self.elements
        self.open.append((tag, out, container, region))

    def _close(self, tag: str, within: frozenset | set = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self._top()[1]:
            self.parts.append(data)
            if any(x[0] == "a" for x in self.open):
                self.linked += len("".join(data.split()))


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Ratios under a Gaussian along the page, weights renormalised at its ends."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius:radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius:radius + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The point halfway between the means of the values below and above it."""
    t = float(values.mean())
    for _ in range(50):
        low, high = values[values < t], values[values >= t]
        new = (float(low.mean()) if len(low) else t) / 2 + float(high.mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def upper_cluster(ratios: np.ndarray) -> np.ndarray:
    """Which ratios are in the upper cluster.  One that is nearer to the mean of
    that cluster than to zero is in it too, so even text is not cut in two."""
    cut = threshold(ratios)
    high = ratios[ratios >= cut]
    return ratios >= min(cut, high.mean() / 2) if len(high) else np.ones(len(ratios), bool)


def content(lines: list[Line], parents: dict[int, int], upper: np.ndarray) -> set[int]:
    """The containers that hold the content."""
    spans: dict[int, list[int]] = {}            # of a container: its first and last line, characters, those in links
    for k, x in enumerate(lines):
        span = spans.setdefault(x.container, [k, k, 0, 0])
        span[1], span[2], span[3] = k, span[2] + len("".join(x.text.split())), span[3] + x.linked
    plain = {c for c, (_, _, size, linked) in spans.items() if 2 * linked <= size}
    dense = {x.container for x, up in zip(lines, upper, strict=True) if up}
    chosen = dense & plain or plain or dense
    regions = {x.region for x in lines if x.container in chosen and x.region >= 0}
    inside: dict[int, tuple[int, int]] = {}     # of a container: first and last line of the content in it and its children
    for c in chosen:
        for p in {c, parents.get(c, 0)}:
            first, last = inside.get(p, (len(lines), -1))
            inside[p] = min(first, spans[c][0]), max(last, spans[c][1])

    def between(c: int) -> bool:
        at = c
        while at:
            at = parents.get(at, 0)
            if at in inside and inside[at][0] < spans[c][0] and spans[c][1] < inside[at][1]:
                return True
        return False

    return chosen | {x.container for x in lines if x.container in plain - chosen and (x.region in regions or between(x.container))}


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The lines of the content, joined by line feeds; "" if there are none."""
    if not html:
        return ""
    events = Events()
    for at in range(0, len(html), FEED):
        events.feed(html[at:at + FEED])
    events.close()
    events.end_line()
    lines = events.lines
    if not lines:
        return ""
    sizes = np.array([len(x.text) for x in lines], float)
    ratios = smoothed(sizes / np.maximum(1, [x.tags for x in lines]), sigma)
    kept = content(lines, events.parents, upper_cluster(ratios))
    return "\n".join(x.text for x in lines if x.container in kept)


def extracted(pages: DataFrame, sigma: float = 1.0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without content lines, give an empty text.
    Further columns are not read; repeated rows stay.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h, sigma) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    d = pick(pages, page_id=page_id, url=url, html=html)
    return by_text_id(d, run, "page_id string, url string, text string, n_chars long", "page_id")
