"""Source divergence audit: how far the sources of a language differ in their words.

Late materialization of strings: tasks count terms locally, and what Spark then
shuffles of a term is a 64-bit digest.  Smallest and largest string of every
kept digest show collisions, and only such digests are counted again by their
strings.  Text comes back once, for the few terms that are returned.

Values are whole numbers throughout, so the result is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.llm.common import col, written

#: fixed rule of a term, on UTF-8 bytes: A-Z lower-cased, every other ASCII byte but a-z ends a term
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: bytes of a text that are split at once; local counts that a task holds before it hands them on
PIECE, HELD = 1 << 20, 400_000


@dataclass(frozen=True)
class Audit:
    """Terms in at least ``least_docs`` documents of their language are kept;
    ``top`` ranks of terms are returned.  The other numbers bound what a task
    holds and change no result: ``bucket`` terms by twice ``block`` sources.
    ``digest_bits`` below 64 provoke collisions in tests.
    """
    least_docs: int = 10
    top: int = 10
    bucket: int = 2048
    block: int = 64
    digest_bits: int = 64


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces cut between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE
        plain = text[at:end].translate(LETTERS)
        if end < len(text):
            cut = plain.rfind(b" ")
            while cut < 0:       # one term longer than a piece
                end += PIECE
                plain = text[at:end].translate(LETTERS)
                cut = len(plain) if end >= len(text) else plain.rfind(b" ")
            plain = plain[:cut]
        yield plain.split()
        at += max(1, len(plain))


def local_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of parts of ``docs`` (lang, source, text)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()),
                         pa.array(list(n.values()), pa.int64()), pa.array([in_docs[t] for t in n], pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in _terms(text):
                    n.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / total), by long division in base 1000, so that nothing overflows."""
    div = lambda a, b: F.call_function("div", a, b)
    x = (n + 2) * 1000
    y = x % total * 1000
    return 1 + div(x, total) * 1_000_000 + div(y, total) * 1000 + div(y % total * 1000, total)


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    x = (n + 2) * 1000
    y = x % total * 1000
    return 1 + x // total * 1_000_000 + y // total * 1000 + y % total * 1000 // total


def _pair_sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Summed gaps of the pairs of two blocks of sources over one bucket of terms.

    Rows without a digest name the sources of the blocks.
    """
    lang, _, first, second = (k.as_py() for k in key)
    src, n, total = (table.column(c).to_numpy() for c in ("src", "n", "total"))
    digest, part = table.column("digest"), table.column("part")
    is_source = np.asarray(digest.is_null())
    ids, at = np.unique(src[is_source], return_index=True)
    totals = total[is_source][at]
    cells = np.flatnonzero(~is_source)
    terms: dict[tuple, int] = {}
    place = np.array([terms.setdefault(t, len(terms)) for t in zip(digest.take(cells).to_pylist(), part.take(cells).to_pylist(), strict=True)], np.int64)
    counts = np.zeros((len(ids), len(terms)), np.int64)
    counts[np.searchsorted(ids, src[cells]), place] = n[cells]
    p = _shares(counts, totals[:, None])
    block = table.column("block").to_numpy()[is_source][at]
    out_a, out_b, out_v = [], [], []
    for i in np.flatnonzero(block == first):
        others = np.flatnonzero((block == second) & (ids > ids[i] if first == second else True))
        if len(others):
            d = p[others] - p[i]
            out_a.append(np.full(len(others), ids[i]))
            out_b.append(ids[others])
            out_v.append((d * d // (p[others] + p[i])).sum(axis=1))
    a, b, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b, out_v))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a), "b": pa.array(b), "value": pa.array(v),
                     "seen": pa.array(np.full(len(a), len(terms), np.int64))})


def _kept(counts: DataFrame, key: list[str], least: int) -> DataFrame:
    """(lang, source, key, n) of keys in enough documents of their language: one exchange, on language and key."""
    dealt = counts.repartition("lang", *key)
    sums = dealt.groupBy("lang", *key, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    within = F.sum("docs").over(W.partitionBy("lang", *key))
    return sums.withColumn("_all", within).filter(F.col("_all") >= least).drop("_all", "docs")


def audited(df: DataFrame, audit: Audit = Audit(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` compares each source with each other source of its language
    over all kept terms; part ``term`` lists the kept terms that a source uses
    above the share of its language, ``audit.top`` of them.  Null text, language
    and source count as ''.  Repeated rows are documents of their own.  Sources
    without terms have all shares equal; a language without kept terms has
    pairs of value 0.  An empty table gives no rows.
    """
    docs = df.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    # the digest is computed again on reading: it compresses worse than the words
    local = written(local_counts(docs), "audit-local")
    digest = F.xxhash64("term") if audit.digest_bits >= 64 else F.xxhash64("term").bitwiseAND((1 << audit.digest_bits) - 1)
    hashed = local.withColumn("digest", digest)
    counts = written(_kept(hashed.select("lang", "source", "digest", "n", "docs"), ["digest"], audit.least_docs), "audit-counts")
    names = (hashed.join(counts.select("lang", "digest").distinct(), ["lang", "digest"], "left_semi")
             .groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("last")))
    names = written(names, "audit-names")
    clash = names.filter(F.col("term") != F.col("last")).select("lang", "digest")
    counts = counts.withColumn("part", F.lit(""))
    names = names.select("lang", "digest", F.lit("").alias("part"), "term")
    if not clash.isEmpty():
        split = hashed.join(clash, ["lang", "digest"], "left_semi").withColumn("part", F.col("term"))
        split = written(_kept(split.select("lang", "source", "digest", "part", "n", "docs"), ["digest", "part"], audit.least_docs), "audit-split")
        counts = counts.join(clash, ["lang", "digest"], "left_anti").unionByName(split)
        names = names.join(clash, ["lang", "digest"], "left_anti").unionByName(
            split.select("lang", "digest", "part", F.col("part").alias("term")).distinct())
        counts, names = written(counts, "audit-counts"), written(names, "audit-names")

    langs = names.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"),
                           (F.coalesce("used", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total"),
                           (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("src"))
    groups = written(groups.withColumn("block", F.call_function("div", F.col("src"), F.lit(audit.block))), "audit-groups")

    pairs, terms = _pairs(counts, groups, audit), _top_terms(counts, names, groups, audit)
    return pairs.unionByName(terms)


def _pairs(counts: DataFrame, groups: DataFrame, audit: Audit) -> DataFrame:
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / audit.bucket)).cast("long")
    cells = counts.join(groups, ["lang", "source"]).withColumn("bucket", F.pmod(F.xxhash64("digest", "part"), buckets))
    heads = groups.filter("v > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("bucket"))
    heads = heads.select("*", F.lit(None).cast("long").alias("digest"), F.lit(None).cast("string").alias("part"), F.lit(0).cast("long").alias("n"))
    shown = ["lang", "bucket", "block", "src", "digest", "part", "n", "total"]
    last = groups.groupBy("lang").agg(F.max("block").alias("last"))
    both = cells.select(shown).unionByName(heads.select(shown)).join(last, "lang")
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    both = both.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other", "last")
    sums = both.groupBy("lang", "bucket", "first", "second").applyInArrow(_pair_sums, "lang string, a long, b long, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    sums = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "seen"))
    a = groups.select("lang", "source", "v", F.col("src").alias("a"), F.col("total").alias("total_a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("src").alias("b"), F.col("total").alias("total_b"))
    out = a.join(b, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    zero = F.lit(0).cast("long")
    # terms that neither block of sources has
    unseen = F.when(F.col("v") > 0, (F.col("v") - F.coalesce("seen", zero)) * gap(share(zero, F.col("total_a")), share(zero, F.col("total_b"))))
    out = out.withColumn("value", F.coalesce("value", zero) + F.coalesce(unseen, zero))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return out.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _top_terms(counts: DataFrame, names: DataFrame, groups: DataFrame, audit: Audit) -> DataFrame:
    everywhere = counts.groupBy("lang", "digest", "part").agg(F.sum("n").alias("all_n"))
    total = groups.groupBy("lang").agg((F.sum(F.col("total") - 2 * F.col("v")) + 2 * F.max("v")).alias("all_total"))
    rows = (counts.filter("n > 0").join(everywhere, ["lang", "digest", "part"]).join(groups.select("lang", "source", "total"), ["lang", "source"])
            .join(total, "lang"))
    p, q = share(F.col("n"), F.col("total")), share(F.col("all_n"), F.col("all_total"))
    rows = rows.withColumn("p", p).withColumn("q", q).filter("p > q").withColumn("value", gap(F.col("p"), F.col("q")))
    by_value = F.rank().over(W.partitionBy("lang", "source").orderBy(F.desc("value")))
    # ties at the end stay until their texts decide
    rows = rows.withColumn("_r", by_value).filter(F.col("_r") <= audit.top).select("lang", "source", "digest", F.col("part"), "value")
    rows = rows.join(names, ["lang", "digest", "part"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= audit.top)
    return rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
