"""Near-duplicate classes by MinHash with tensored banding.

Two families of small hash collections are computed per shingle set.  A table
key is the pair of one collection's value from each family, so ``m`` values of
either family make ``m * m`` tables from ``2 * m`` collections.  Values that no
other set shares are dropped before pairs are formed, which loses no bucket.

Candidates are verified on the full shingle sets.  Buckets are not expanded
into pairs: first every set meets the most central partner of its buckets, then
members of a bucket that are still in different classes are compared where one
of their rarest shingles is the same, without which they cannot be similar.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from quadrille.llm.common import by_text_id, col, cut, pick, written
from quadrille.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
MEMO_WORDS = 400_000
#: buckets of 32,768 bits (4 KB each, 2 MB in all) that tell tasks which documents have a partner
SIEVE_BUCKETS = 512


@dataclass(frozen=True)
class Banding:
    """words: length of a shingle.  percent: least similarity of a link.
    collections, hashes: values per family and minhashes per value.  A pair of
    similarity s shares a table unless one family misses all its collections:
    at most 2 * (1 - s**hashes)**collections, 6e-6 at s = 0.8 as set."""

    words: int = 5
    percent: int = 80
    collections: int = 24
    hashes: int = 4
    star_rounds: int = 2


class _Words(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_digest(word)
        return value


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text, A-Z lower-cased.

    A text with fewer words gives one shingle of all its words; one without
    words, or null, the empty set.
    """
    found = WORD.findall((text or "").encode().lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(_words.__getitem__, found)), "<u8")
    n = min(words, len(h))
    rolled = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    return np.unique(rolled)


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20011)
    return (r.integers(0, 1 << 32, (count, 1), dtype=np.uint64).astype(np.uint32),
            (r.integers(0, 1 << 31, (count, 1), dtype=np.uint64) * 2 + 1).astype(np.uint32))


def minhashes(hashes: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of every seeded permutation over a non-empty set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        y = x[None, at:at + 512] ^ flips
        y *= factors
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def _signatures(b: Banding):
    flips, factors = _seeds(2 * b.collections * b.hashes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingles(text, b.words)
                if not len(s):
                    rows.append((doc_id, 0, None, None))
                    continue
                mins = minhashes(s, flips, factors).reshape(-1, b.hashes).astype(np.uint64)
                key = np.arange(len(mins), dtype=np.uint64)     # tells collections and families apart
                for k in range(b.hashes):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, k])
                rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), key.astype(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "values"])
    return run


def _place(doc_id: str):
    return F.pmod(F.xxhash64(doc_id), F.lit(SIEVE_BUCKETS * 32768))


def _sets(b: Banding, sieve):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(sieve.value, np.uint8)
        for pdf in batches:
            at = pdf["place"].to_numpy()
            pdf = pdf[(bits[at >> 3] >> (at & 7) & 1).astype(bool)]
            yield pd.DataFrame({"id": pdf["doc_id"], "members": [shingles(t, b.words).tobytes() for t in pdf["text"]]})
    return run


def _sets_of(docs: DataFrame, members: DataFrame, b: Banding) -> DataFrame:
    """(id, members): the shingle sets of the documents in ``members`` (doc_id), and few more.

    A join would shuffle every text to find the few that are asked for.  The ids
    set bits of a table of one size, whatever their number, and each task keeps
    the texts whose bit is set; other ids that meet such a bit stay in, and no
    later join asks for them.
    """
    place = _place("doc_id")
    rows = (members.select(F.floor(place / 32768).alias("bucket"), (place % 32768).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    table = bytearray(SIEVE_BUCKETS * 4096)
    for r in rows:
        table[r["bucket"] * 4096:(r["bucket"] + 1) * 4096] = r["bits"]
    sieve = docs.sparkSession.sparkContext.broadcast(bytes(table))
    asked = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", place.alias("place"))
    return asked.mapInPandas(_sets(b, sieve), "id long, members binary")


def _confirmed(b: Banding):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for left, right in zip(pdf["left_set"], pdf["right_set"], strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= b.percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]
    return run


def _verified(pairs: DataFrame, sets: DataFrame, b: Banding) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough.

    The second set is attached straight before the comparison and so never
    shuffled once per pair.
    """
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("left_set"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("right_set"))
    return pairs.join(right, "b").join(left, "a").mapInPandas(_confirmed(b), "a long, b long")


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [np.frombuffer(m, np.int64) for m in pdf["members"]]
        if sets:
            size = [len(x) for x in sets]
            own = [xxhash.xxh3_64_intdigest(m) >> 1 for m in pdf["members"]]     # an id may have several sets
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), size), "own": np.repeat(np.array(own, np.int64), size),
                                "n": np.repeat(np.array(size, np.int64), size), "shingle": np.concatenate(sets)})


def _rare_partners(members: DataFrame, left: DataFrame, sets: DataFrame, b: Banding) -> DataFrame:
    """Pairs (a, b) of ``left`` with ``members`` (id, n, class) of other classes that can be similar enough.

    Two sets of similarity s share one of their n - ceil(s * n) + 1 rarest
    shingles, and fewer where their sizes ask for a larger overlap; rare means
    in few members.  Copies with many changes of their own
    have nothing but these among their rarest ones and meet nobody, however
    crowded their buckets are.
    """
    rows = sets.join(members.select("id").distinct(), "id").mapInPandas(_exploded, "id long, own long, n long, shingle long")
    rows = written(rows, "near-shingles")
    often = rows.groupBy("shingle").count()
    place = F.row_number().over(W.partitionBy("id", "own").orderBy("count", "shingle"))      # one text's shingles
    few = F.col("n") - F.ceil(F.col("n") * b.percent / 100) + 1
    rare = written(rows.join(often, "shingle").withColumn("place", place).filter(F.col("place") <= few).select("id", "shingle", "n", "place"), "near-rare")
    mine = rare.join(left.select("id"), "id", "left_semi").join(members.select("id", "class").distinct(), "id")
    other = rare.join(members.select("id", "class").distinct(), "id").select(
        "shingle", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("place").alias("other_place"), F.col("class").alias("other_class"))
    # what two sets of these sizes must share, and how far down their lists the first of it stands at most
    overlap = F.ceil((F.col("n") + F.col("other_n")) * b.percent / (100 + b.percent))
    early = (F.col("place") <= F.col("n") - overlap + 1) & (F.col("other_place") <= F.col("other_n") - overlap + 1)
    return (mine.join(other, "shingle").filter("class <> other_class").filter(_near_sizes(b)).filter(early)
            .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())


def _near_sizes(b: Banding):
    return (F.col("n") * 100 >= F.col("other_n") * b.percent) & (F.col("other_n") * 100 >= F.col("n") * b.percent)


def _links(reps: DataFrame, docs: DataFrame, b: Banding) -> DataFrame:
    """Classes (id, component) among representatives (id, n, values)."""
    values = reps.select("id", "n", F.posexplode("values").alias("at", "value"))
    shared = values.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("value")
    mine = (values.join(shared, "value").groupBy("id", "n")
            .agg(F.collect_list(F.when(F.col("at") < b.collections, F.col("value"))).alias("first"),
                 F.collect_list(F.when(F.col("at") >= b.collections, F.col("value"))).alias("second")))
    # who shares much is central to its group
    keyed = (mine.withColumn("central", F.size("first") * F.size("second")).withColumn("v", F.explode("first")).withColumn("w", F.explode("second"))
             .select(F.xxhash64("v", "w").alias("key"), "id", "n", "central"))
    keyed = written(keyed, "near-tables")
    full = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.struct("central", -F.col("id"))).alias("top")).filter("lo < hi")
    full = full.select("key", (-F.col("top")["col2"]).alias("hub"), F.col("top.central").alias("hub_central"))
    # a set and the most central member of each of its buckets; a pair has many tables, but stands here once
    stars = written(keyed.select("key", "id", "n").join(full, "key").select("id", "n", "hub", "hub_central").distinct(), "near-stars")
    # the sets of documents with a partner, computed once
    members = stars.select(F.col("id").alias("doc_id")).distinct()
    sets = written(_sets_of(docs, members, b), "near-sets")

    hub_sizes = stars.select(F.col("id").alias("hub"), F.col("n").alias("other_n")).distinct()
    tried = classes = None
    for turn in range(b.star_rounds + 1):
        now = stars
        if classes is not None:
            now = (stars.join(classes, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
                   .join(classes.select(F.col("id").alias("hub"), F.col("component").alias("hub_class")), "hub", "left")
                   .withColumn("hub_class", F.coalesce("hub_class", "hub")))
            apart = now.filter("class <> hub_class")
        else:
            apart = now.filter("id <> hub")
        if turn < b.star_rounds:    # one partner for each set: the most central one it shares a bucket with
            pairs = (apart.select("id", "n", "hub", "hub_central").distinct().join(hub_sizes, "hub").filter(_near_sizes(b))
                     .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), "id", "hub_central"))
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = pairs.groupBy("id").agg(F.max(F.struct("hub_central", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        else:       # whatever shares a bucket, hence its hub, with a member of another class
            mixed = written(now.join(apart.select("hub").distinct(), "hub", "left_semi").select("id", "n", "class").distinct(), "near-mixed")
            pairs = _rare_partners(mixed, apart.select("id").distinct(), sets, b).join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if pairs.isEmpty():
            if turn < b.star_rounds and tried is not None:
                continue
            break
        found = cut(_verified(pairs, sets, b))
        tried = pairs if tried is None else tried.union(pairs)
        # the classes so far stand for the links that made them
        links = found if classes is None else found.union(classes.select(F.col("id").alias("a"), F.col("component").alias("b")))
        classes = components(links)
    if classes is None:
        return reps.select("id", F.col("id").alias("component")).limit(0)
    return classes


def classes(docs: DataFrame, banding: Banding = Banding(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when the Jaccard similarity of their shingle sets reaches
    ``banding.percent``; component_id is the smallest doc_id reachable, kept
    marks the row that bears it.  Equal sets form one class without a
    comparison.  Null and empty texts are linked with nothing.  Rows that share
    a doc_id are one node and get the same class.  A null doc_id has a null
    component_id and is kept.
    """
    d = pick(docs, doc_id=doc_id, text=text)
    signed = written(by_text_id(d, _signatures(banding), "doc_id string, n_shingles long, digest string, values array<long>", "doc_id"), "near-signatures")
    known = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    same = known.groupBy("digest").agg(F.min("doc_id").alias("id"))
    reps = known.join(same.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"]).groupBy("doc_id", "digest").agg(
        F.first("n_shingles").alias("n"), F.first("values").alias("values")).select(F.col("doc_id").alias("id"), "n", "values")
    groups = _links(reps, d, banding)
    # rows to their representative, representatives to their class; a doc_id with several texts ties their classes together
    home = known.select("doc_id", "digest").join(same, "digest").join(groups, "id", "left").select(
        "doc_id", F.coalesce("component", "id").alias("home"))
    home = cut(home.distinct())
    several = home.groupBy("doc_id").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).filter("lo < hi")
    if not several.isEmpty():
        joined = components(several.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(
            home.join(several.select("doc_id"), "doc_id").select(F.col("home").alias("a"), F.col("doc_id").alias("b"))))
        home = home.join(joined.withColumnRenamed("id", "home"), "home", "left").select("doc_id", F.coalesce("component", "home").alias("home"))
    home = home.groupBy("doc_id").agg(F.min("home").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.col("digest").isNotNull().alias("has")).join(home, "doc_id", "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, banding: Banding = Banding(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every class: that with the smallest id."""
    gone = classes(docs, banding, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{doc_id}`"] == gone["__gone"], "left_anti").select(*[col(c) for c in docs.columns])
