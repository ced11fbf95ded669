"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille.llm.common import cut

#: edges a task takes; fewer edges are not spread over more tasks than there are cores
TASK_EDGES = 100_000


def _packed(df: DataFrame, edges: int) -> DataFrame:
    """``df`` in as many tasks as its edges ask for.

    Each task of a shuffle or checkpoint writes files of its own, and a block of
    disk for each of them, however few rows it has; a loop over a small graph
    would fill the disk with those.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 1 + edges // TASK_EDGES))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every endpoint of ``edges`` (a, b); component is the
    smallest id reachable.

    Alternates two steps until nothing changes: every node hands the smallest
    of its neighbourhood to its larger neighbours, then to its smaller ones.
    Each step groups by node with a map-side minimum and joins it back, so a
    hub's neighbours are never gathered in one row.  Self-links and nulls are
    ignored; repeated and reversed edges count once.
    """
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .filter("u IS NOT NULL AND v IS NOT NULL").distinct())
    e = cut(e)
    n, before = e.count(), None
    e = _packed(e, n)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        # large star: larger neighbours of u point at the smallest around u
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.union(low.filter("m < u").select("u", F.col("m").alias("v")))
        large = _packed(_packed(large, 2 * n).distinct(), 2 * n)
        # small star: smaller neighbours of u, and u, point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        e = cut(_packed(_packed(small, 2 * n).distinct(), 2 * n))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
