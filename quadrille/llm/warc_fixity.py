"""Fixity of WARC replicas by Merkle trees over ordered offset ranges.

A leaf is a record: its offset, length and sha256.  A node of the first level
hashes the leaves, in order, whose offsets fall into one range of RANGE bytes;
a node above hashes FANOUT neighbouring ranges; the root covers the file.  An
audit compares the roots of two replicas and descends level by level into the
nodes that differ, so the leaves of sound files are never compared.

DataFrame functions only.  Every group is bounded: a range holds no more
records than fit into it, a node FANOUT children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.llm.common import col, pick, written

RANGE, FANOUT, PAGES_PER_FILE = 1 << 16, 16, 512


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text; nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            pages_per_file: int = PAGES_PER_FILE) -> DataFrame:
    """(page_id, warc_file, record): pages in files of consecutive ids; pages without an id in file -1."""
    p = pick(pages, page_id=page_id, url=url, html=html)
    file = F.coalesce(F.floor(F.col("page_id") / pages_per_file), F.lit(-1)).cast("long")
    return p.select("page_id", file.alias("warc_file"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def manifest(rows: DataFrame) -> DataFrame:
    """(page_id, warc_file, record_offset, record_length, sha256) of :func:`records`.

    Offsets follow the ids, then the hashes, so equal rows stand side by side.
    The running sum goes over one file's lengths, not its contents.
    """
    sized = rows.select("page_id", "warc_file", F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("sha256"))
    order = W.partitionBy("warc_file").orderBy(F.col("page_id").asc_nulls_first(), "sha256").rowsBetween(W.unboundedPreceding, -1)
    return sized.select("page_id", "warc_file", F.coalesce(F.sum("record_length").over(order), F.lit(0)).alias("record_offset"), "record_length", "sha256")


def _nodes(children: DataFrame, node: Column, place: str, digest: Column) -> DataFrame:
    """One node per file and range: the hash of its children in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), digest.alias("digest"))))
    text = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["at"].cast("string"), x["digest"])), ",")
    return children.groupBy("warc_file", node.alias("node")).agg(text.alias("text")).select("warc_file", "node", F.sha2("text", 256).alias("hash"))


def tree(leaves: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The levels of the trees of all files, from ranges up to roots, as written tables."""
    leaf = F.concat_ws(":", F.col("record_length").cast("string"), F.col("sha256"))
    out = [written(_nodes(leaves, F.floor(F.col("record_offset") / RANGE).cast("long"), "record_offset", leaf), f"{name}-0")]
    for k in range(1, levels):
        out.append(written(_nodes(out[-1], F.floor(F.col("node") / FANOUT).cast("long"), "node", F.col("hash")), f"{name}-{k}"))
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """The records in which two replicas differ: warc_file, record_offset,
    record_length, expected_sha256 (left), actual_sha256 (right), status.

    ``left`` and ``right`` have warc_file, record_offset, record_length and
    sha256 per readable record, and maybe more columns.  status is changed,
    missing (only left) or extra (only right).  A file that one replica lacks
    differs as a whole.  Records that stand twice at one offset are compared
    by their sorted hashes.  Two empty replicas agree.
    """
    keys = ["warc_file", "record_offset"]
    own = lambda df: pick(df, warc_file="warc_file", record_offset="record_offset", record_length="record_length", sha256="sha256")
    a, b = written(own(left), "fixity-left"), written(own(right), "fixity-right")
    end = a.union(b).agg(F.max("record_offset")).first()[0] or 0      # one number
    levels, reach = 1, RANGE
    while reach <= end:
        levels, reach = levels + 1, reach * FANOUT
    trees = tree(a, levels, "fixity-left"), tree(b, levels, "fixity-right")
    suspect = None
    for k in range(levels - 1, -1, -1):
        sides = []
        for t, hash_name in zip(trees, ("left_hash", "right_hash"), strict=True):
            level = t[k].withColumnRenamed("hash", hash_name)
            if suspect is not None:
                level = level.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long"))
                level = level.join(suspect.select("warc_file", F.col("node").alias("parent")), ["warc_file", "parent"], "left_semi").drop("parent")
            sides.append(level)
        suspect = sides[0].join(sides[1], ["warc_file", "node"], "full").filter(~F.col("left_hash").eqNullSafe(F.col("right_hash"))).select("warc_file", "node")
        suspect = written(suspect, f"fixity-suspect-{k}")
    found = []
    for df, side in ((a, "expected"), (b, "actual")):
        inside = df.withColumn("node", F.floor(F.col("record_offset") / RANGE).cast("long")).join(suspect, ["warc_file", "node"], "left_semi")
        found.append(inside.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("sha256")), ",").alias(f"{side}_sha256"),
                                               F.max("record_length").alias(f"{side}_length")))
    both = found[0].join(found[1], keys, "full")
    differs = ~F.col("expected_sha256").eqNullSafe(F.col("actual_sha256")) | ~F.col("expected_length").eqNullSafe(F.col("actual_length"))
    status = F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "extra").otherwise("changed")
    return both.filter(differs).select(*keys, F.coalesce("expected_length", "actual_length").alias("record_length"),
                                       "expected_sha256", "actual_sha256", status.alias("status"))


def located(found: DataFrame, index: DataFrame) -> DataFrame:
    """``found`` with the page_id that the index (a manifest) has at its place; null where it has none."""
    at = index.select("warc_file", "record_offset", col("page_id").alias("page_id"))
    return found.join(at, ["warc_file", "record_offset"], "left")
