"""Stored quads: partitioned by predicate, bucketed and sorted by subject, with a typed number column.

A bound predicate selects one folder, a bound subject one bucket of it, and a
numeric range prunes row groups on ``num``.  Patterns on one subject join
bucket by bucket without an exchange.  Statements with a resource object are
kept a second time by object, so that look-ups against the direction of a
statement select one bucket as well.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.functions import terms as t
from quadrille.session import shared_folder

#: a partition's value is a folder name, which file systems bound; longer predicates share folders by digest
FOLDER = 120
#: statements a bucket holds on average; what one task writes, sorts or joins of a large dataset
BUCKET_ROWS = 1_000_000


@dataclass(frozen=True)
class Store:
    """``by_subject``: quads and ``num``, bucketed by subject.  ``by_object``:
    quads with a resource object, bucketed by it."""
    by_subject: DataFrame
    by_object: DataFrame

    @property
    def quads(self) -> DataFrame:
        return self.by_subject.select(*m.QUAD_COLS)

    def union(self, other: Store) -> Store:
        return Store(self.by_subject.unionByName(other.by_subject), self.by_object.unionByName(other.by_object))


def number() -> Column:
    """Numeric value of the object as a double, NULL for other terms.

    Rounding keeps order, so a bound on ``num`` that admits equality leaves out
    no statement that an exact comparison would keep.
    """
    return t.double_value(t.object_term())


def _saved(df: DataFrame, folder: str, key: str, second: str, buckets: int, path: str) -> DataFrame:
    name = f"quads_{uuid.uuid4().hex}"
    # one task a bucket, so a bucket of a predicate is one sorted file
    writer = df.repartition(buckets, key).write.format("parquet").partitionBy(folder).bucketBy(buckets, key).sortBy(key, second)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def save(quads: DataFrame, path: str | None = None, buckets: int | None = None, rows: int = 0) -> Store:
    """Writes ``quads`` below ``path`` (default: a new folder in the shared one)
    and returns the stored tables, registered in the session's catalogue.

    ``buckets`` defaults to the shuffle partitions of the session, but not more
    than it has cores, since each bucket of each predicate is a file; where
    ``rows`` statements are expected, as many as keep to BUCKET_ROWS each.  The
    partition column is ``p`` itself; only where a predicate exceeds FOLDER
    characters, which no folder name would hold, the folders are digests and
    ``p`` is a column inside.
    """
    spark = quads.sparkSession
    path = path or f"{shared_folder(spark)}/quads-{uuid.uuid4().hex}"
    buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, spark.sparkContext.defaultParallelism))
    buckets = max(buckets, -(-rows // BUCKET_ROWS)) if rows else buckets
    table, folder = quads.select(*m.QUAD_COLS).withColumn("num", number()), "p"
    if not quads.filter(F.length("p") > FOLDER).isEmpty():
        table, folder = table.withColumn("folder", F.sha1("p")), "folder"
    one = _saved(table, folder, "s", "pos", buckets, f"{path}/by-subject")
    two = _saved(one.filter(m.is_resource()).drop("num"), folder, "o", "s", buckets, f"{path}/by-object")
    return Store(one, two)


def matching(store: Store, p: str, s: str | None = None, o: str | None = None,
             least: float | None = None, most: float | None = None) -> DataFrame:
    """Statements of one predicate by subject, resource object or numeric range (bounds included)."""
    rows = (store.by_object if o is not None and s is None else store.by_subject).filter(F.col("p") == p)
    if "folder" in rows.columns:
        rows = rows.filter(F.col("folder") == F.sha1(F.lit(p)))
    for name, value in (("s", s), ("o", o)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if o is not None:
        rows = rows.filter(m.is_resource())
    if least is not None:
        rows = rows.filter(F.col("num") >= float(least))
    if most is not None:
        rows = rows.filter(F.col("num") <= float(most))
    return rows
