"""Exact substring deduplication with suffix arrays.

A byte is removed when a string of WINDOW bytes that covers it also starts
earlier: in a document of smaller id, or earlier in its own.

Shards are formed by content, so that equal strings meet.  Every window picks
an anchor, the smallest hash of its SEED-byte strings; equal windows pick equal
anchors.  Only windows of anchors that occur again can repeat; the stretch of
text under the windows of one anchor (its context, at most 2 * WINDOW - SEED
bytes) goes to the shard of the anchor's hash, equal contexts once per batch.
In a shard the contexts are sorted as suffixes by Larsson-Sadakane refinement,
Kasai's common prefixes tell which neighbours share a whole window, and the
earliest owner of every window keeps it.  An anchor with many contexts is
spread over several shards; what is first in its shard is merged across them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from quadrille.llm.common import pick, written
from quadrille.session import global_index

WINDOW, SEED = 100, 32
SPAN = WINDOW - SEED + 1        # seeds in a window
#: bytes of contexts in one suffix array; occurrences of an anchor in one shard
SHARD_BYTES, SHARD_ANCHORS, SALTS = 4 << 20, 50_000, 61


def seed_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all SEED-byte strings, by doubling a polynomial hash."""
    h, base, size = b.astype(np.uint64) + np.uint64(1), np.array([0x9E3779B97F4A7C15], np.uint64), 1
    while size < SEED:
        h = h[:-size] * base + h[size:]
        base, size = base * base, size * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of every anchor of a text: the windows
    between choose it, as the leftmost of their seeds with the smallest upper hash half."""
    if len(b) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = seed_hashes(b)
    # upper half of the hash over the place: the least is the leftmost smallest
    low, size = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= SPAN:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[:len(low) - (SPAN - size)], low[SPAN - size:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(low) - 1]])
    return h[place[first]], first, last


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order.

    Starts from the order of seven-byte prefixes; each round doubles the sorted
    length by the ranks that many bytes on, and re-sorts only suffixes whose
    group is not a single one.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])      # zero: past the end
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k:k + n]
    sa = np.argsort(key)
    fresh = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    starts = np.flatnonzero(fresh)
    group = np.repeat(starts, np.diff(np.append(starts, n)))       # rank: where the group starts
    rank = np.empty(n + 1, np.int64)
    rank[sa] = group
    rank[n] = -1
    h = 7
    while True:
        size = np.diff(np.append(np.flatnonzero(fresh), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))         # places in sa whose group has several
        if not len(open_):
            break
        who = sa[open_]
        pair = (rank[who] << 32) | (rank[np.minimum(who + h, n)] + 1)
        order = np.argsort(pair)
        who, pair = who[order], pair[order]
        sa[open_] = who
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        fresh[open_] = new
        heads = np.flatnonzero(new)
        rank[who] = np.repeat(open_[heads], np.diff(np.append(heads, len(open_))))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with its predecessor in ``sa``, up to ``cap``.

    Going one byte on inside a context shortens the prefix by one at most; all
    contexts take this walk side by side.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(cap + 1, np.uint8)])
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = np.where(place > 0, sa[np.maximum(place - 1, 0)], -1)
    out = np.zeros(n, np.int64)
    length = np.zeros(len(starts), np.int64)
    for step in range(int(sizes.max())):
        lanes = np.flatnonzero(sizes > step)
        at = starts[lanes] + step
        prev = before[at]
        size = np.maximum(length[lanes] - 1, 0)
        size[prev < 0] = 0
        going = np.flatnonzero(prev >= 0)
        while len(going):
            s = size[going]
            more = (s < cap) & (np.maximum(at[going], prev[going]) + s < n) & (padded[at[going] + s] == padded[prev[going] + s])
            going = going[more]
            size[going] += 1
        length[lanes] = size
        out[at] = size
    return out[sa]


def first_windows(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Per context the offsets of its windows that no earlier context of the list holds."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    sa = suffix_array(text)
    shared = common_prefixes(text, sa, begins, sizes, WINDOW)
    label = np.cumsum(shared < WINDOW)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(text)) - begins[owner]
    owned = offset[sa] <= sizes[owner[sa]] - WINDOW
    who, label = sa[owned], label[owned]
    # order of (document, start) as one number
    doc_rank = np.unique(docs, return_inverse=True)[1]
    when = (doc_rank[owner[who]].astype(np.int64) << 32) | (starts[owner[who]] + offset[who])
    heads = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    least = np.minimum.reduceat(when, heads)
    first = who[when == np.repeat(least, np.diff(np.append(heads, len(when))))]
    first.sort()
    return np.split(offset[first], np.searchsorted(owner[first], np.arange(1, len(contexts))))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive numbers in a sorted array, as (first, last)."""
    if not len(values):
        return []
    cuts = np.flatnonzero(np.diff(values) != 1)
    return list(zip(values[np.concatenate([[0], cuts + 1])].tolist(), values[np.concatenate([cuts, [len(values) - 1]])].tolist(), strict=True))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """seed, doc, at = first window * 128 + number of further windows; the first
    row of a seed in a batch also tells how many there are (``local``), the
    others are known to be repeated and are spread by ``salt``."""
    for pdf in batches:
        seeds, docs, at = [], [], []
        for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
            h, first, last = anchors(_bytes(text))
            seeds.append(h.astype(np.int64))
            docs.append(np.full(len(h), doc, np.int64))
            at.append(first * 128 + (last - first))
        if not seeds:
            continue
        seed = np.concatenate(seeds)
        order = np.argsort(seed)
        heads = np.flatnonzero(np.concatenate([[True], seed[order][1:] != seed[order][:-1]]))[:len(seed)]
        size = np.diff(np.append(heads, len(seed)))
        turn = np.empty(len(seed), np.int64)
        turn[order] = np.arange(len(seed)) - np.repeat(heads, size)
        local = np.zeros(len(seed), np.int64)
        local[order[heads]] = size
        yield pd.DataFrame({"seed": seed, "doc": np.concatenate(docs), "at": np.concatenate(at),
                            "salt": np.where(turn > 0, 1 + turn % SALTS, 0), "local": local})


def _context_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts of repeated anchors, equal ones of a batch once, at their earliest place."""
    for pdf in batches:
        least: dict[tuple[int, bytes], tuple[int, int]] = {}
        for doc, text, suspects in zip(pdf["doc"], pdf["text"], pdf["suspects"], strict=True):
            data = text.encode()
            for s in suspects:
                lo, more = divmod(s["at"], 128)
                key = (s["seed"], data[lo:lo + more + WINDOW])
                least[key] = min(least.get(key, (doc, lo)), (doc, lo))
        rows = [(h, int.from_bytes(hashlib.blake2b(c, digest_size=4).digest()), c, d, lo) for (h, c), (d, lo) in least.items()]
        yield pd.DataFrame(rows, columns=["seed", "mixed", "context", "doc", "lo"])


def _shard_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows that are first in their shard: doc, from, to; single ones with a digest where the anchor is spread."""
    def resolved(rows: list[tuple]) -> pd.DataFrame:
        least: dict[tuple, tuple] = {}
        for seed, spread, context, doc, lo in rows:
            key = (seed, context)
            if key not in least or (doc, lo) < least[key][:2]:
                least[key] = (doc, lo, spread)
        many: dict[int, int] = {}
        for seed, _ in least:
            many[seed] = many.get(seed, 0) + 1
        out, keys = [], []
        for (seed, context), (doc, lo, spread) in least.items():
            if many[seed] == 1 and not spread:     # nothing to compare with
                out.append((doc, lo, lo + len(context) - WINDOW, None))
            else:
                keys.append((context, doc, lo, spread))
        if keys:
            firsts = first_windows([k[0] for k in keys], np.array([k[1] for k in keys]), np.array([k[2] for k in keys], np.int64))
            for (context, doc, lo, spread), offsets in zip(keys, firsts, strict=True):
                if spread:
                    out += [(doc, lo + o, lo + o, hashlib.blake2b(context[o:o + WINDOW], digest_size=16).digest()) for o in offsets.tolist()]
                else:
                    out += [(doc, lo + a, lo + b, None) for a, b in _runs(offsets)]
        return pd.DataFrame(out, columns=["doc", "from", "to", "digest"])

    rows, size, last = [], 0, None
    for pdf in batches:
        for seed, salt, spread, context, doc, lo in zip(pdf["seed"], pdf["salt"], pdf["spread"], pdf["context"], pdf["doc"], pdf["lo"], strict=True):
            if size >= SHARD_BYTES and (seed, salt) != last:
                yield resolved(rows)
                rows, size = [], 0
            last = (seed, salt)
            rows.append((seed, spread, context, doc, lo))
            size += len(context)
    if rows:
        yield resolved(rows)


def removed(size: int, suspects: list[int], firsts: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the bytes under windows of ``suspects`` (first * 128 + more) that are not in ``firsts``."""
    edge = np.zeros(size + 1, np.int64)
    for s in suspects:
        lo, more = divmod(int(s), 128)
        edge[lo] += 1
        edge[lo + more + 1] -= 1
    repeated = np.cumsum(edge)[:size] > 0
    for lo, hi in firsts:
        repeated[lo:hi + 1] = False
    cover = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(repeated)
    cover[at] += 1
    cover[at + WINDOW] -= 1
    return np.cumsum(cover)[:size] > 0


def _kept_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, suspects, firsts in zip(pdf["doc"], pdf["text"], pdf["suspects"], pdf["firsts"], strict=True):
            b = _bytes(text)
            gone = removed(len(b), [s["at"] for s in suspects], [] if firsts is None else [(f["from"], f["to"]) for f in firsts])
            spans = _runs(np.flatnonzero(gone))
            out.append((doc, int(gone.sum()), len(spans), hashlib.sha256(b[~gone].tobytes()).hexdigest(), b[~gone].tobytes()))
        yield pd.DataFrame(out, columns=["doc", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with distinct ``doc`` in the order of the ids, and where ids
    repeat (doc, doc_id, copies): rows with one id stand in the order of a hash
    of their texts, and of equal rows only one is searched."""
    ids = docs.select("doc_id")
    if ids.filter("doc_id IS NULL").isEmpty() and ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.select(F.col("doc_id").alias("doc"), "text"), None
    keyed = docs.withColumn("th", F.xxhash64("text"))
    groups = keyed.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("copies"))
    index = written(global_index(groups, [F.col("doc_id").asc_nulls_first(), F.col("th")], "doc"), "suffix-index")
    one = keyed.dropDuplicates(["doc_id", "th"])
    same = one["doc_id"].eqNullSafe(index["doc_id"]) & (one["th"] == index["th"])
    return written(one.join(index, same).select("doc", "text"), "suffix-docs"), index.select("doc", "doc_id", "copies")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and kept_bytes (null where nothing is removed).

    Texts are UTF-8 bytes, null and empty ones have none; matches never cross
    documents and are judged on the input.  Null ids come first; rows with one
    id follow a hash of their texts, and of equal rows all but one count as
    later copies.
    """
    d = pick(docs, doc_id=doc_id, text=text)
    rows, index = _numbered(d)
    found = rows.filter(F.octet_length("text") >= WINDOW).mapInPandas(_anchor_rows, "seed long, doc long, at long, salt long, local long")
    again = found.withColumn("n", F.sum("local").over(W.partitionBy("seed", "salt"))).filter("salt > 0 OR n > 1")
    suspects = again.groupBy("doc").agg(F.collect_list(F.struct("seed", "at", "n")).alias("suspects"))
    candidates = written(rows.join(suspects, "doc"), "suffix-candidates")
    # anchors so frequent that their contexts take several shards
    hot = candidates.select(F.explode("suspects").alias("s")).filter(F.col("s.n") > SHARD_ANCHORS)
    hot = written(hot.groupBy("s.seed").agg((F.floor(F.max("s.n") / SHARD_ANCHORS) + 1).alias("shards")), "suffix-hot")
    contexts = candidates.mapInPandas(_context_rows, "seed long, mixed long, context binary, doc long, lo long").join(hot, "seed", "left")
    contexts = contexts.select("seed", F.coalesce(F.col("mixed") % F.col("shards"), F.lit(0)).alias("salt"), F.col("shards").isNotNull().alias("spread"), "context", "doc", "lo")
    firsts = written(contexts.repartition("seed", "salt").sortWithinPartitions("seed", "salt")
                     .mapInPandas(_shard_rows, "doc long, `from` long, `to` long, digest binary"), "suffix-firsts")
    merged = firsts.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc", "from")).alias("m")).select("m.doc", "m.from", F.col("m.from").alias("to"))
    kept = firsts.filter("digest IS NULL").select("doc", "from", "to").union(merged)
    kept = kept.groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("firsts"))
    cut = candidates.join(kept, "doc", "left").mapInPandas(_kept_rows, "doc long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    cut = cut.filter("n_removed > 0")
    info = rows.select("doc", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    zero = F.lit(0).cast("long")
    out = info.join(cut, "doc", "left").select("doc", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                                               F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept_bytes")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
    if index is None:
        return out.select(F.col("doc").alias("doc_id"), *columns)
    out = out.join(index, "doc").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    later = (F.col("copy") > 1) & (F.col("n_bytes") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", "n_bytes", F.when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
                      F.when(later, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(later, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
                      F.when(later, F.lit(b"")).otherwise(F.col("kept_bytes")).alias("kept_bytes"))
