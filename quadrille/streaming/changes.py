"""Change capture between versions and its replay as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.session import global_index

DELTA_COLS = [*m.QUAD_COLS, "op", "seq"]


def _digest(cols: list[str]) -> Column:
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def subject_digests(quads: DataFrame) -> DataFrame:
    """(s, n, digest, blank): order-free signature of every subject.

    Counts and sums combine map-side, so a hot subject is never gathered.
    """
    blank = m.is_bnode(F.col("s")) | (F.col("o_kind") == "bnode")
    return quads.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum(_digest(m.STATEMENT)).alias("digest"), F.max(blank).alias("blank"))


def subject_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(s, op, reload): replace or remove per changed subject; ``reload`` marks
    changes that involve blank nodes and need a full reload."""
    a = subject_digests(old).select("s", F.col("n").alias("na"), F.col("digest").alias("da"), F.col("blank").alias("ba"))
    b = subject_digests(new).select("s", F.col("n").alias("nb"), F.col("digest").alias("db"), F.col("blank").alias("bb"))
    rows = a.join(b, "s", "full").filter(~(F.col("na").eqNullSafe(F.col("nb")) & F.col("da").eqNullSafe(F.col("db"))))
    return rows.select("s", F.when(F.col("nb").isNull(), "remove").otherwise("replace").alias("op"),
                       (F.coalesce("ba", F.lit(False)) | F.coalesce("bb", F.lit(False))).alias("reload"))


def entity_changes(old: DataFrame, new: DataFrame, position: str = "position") -> DataFrame:
    """(iri, change, position): changed, added, removed and moved entities.

    Catalog rows are ``(iri, position, ...)``.  When the kept entities stand
    in a new order, every position is sent; otherwise only new ones.
    """
    data = sorted(c for c in new.columns if c not in ("iri", position))
    a = old.select("iri", _digest(data).alias("da"), F.col(position).alias("pa"))
    b = new.select("iri", _digest(data).alias("db"), F.col(position).alias("pb"))
    rows = a.join(b, "iri", "full")
    kept = rows.filter("pa is not null and pb is not null").select("iri", "pa", "pb")
    before = global_index(kept, [F.col("pa"), F.col("iri")], "ra").select("iri", "ra")
    after = global_index(kept, [F.col("pb"), F.col("iri")], "rb").select("iri", "rb")
    reordered = before.join(after, "iri").agg(F.coalesce(F.max(F.col("ra") != F.col("rb")), F.lit(False))).scalar()
    change = (F.when(F.col("pb").isNull(), "removed").when(F.col("pa").isNull(), "added")
              .when(F.col("da") != F.col("db"), "changed").when(F.col("moved"), "moved"))
    rows = rows.withColumn("moved", reordered).withColumn("change", change).filter("change is not null")
    place = F.when((F.col("change") == "added") | (F.col("moved") & (F.col("change") != "removed")), F.col("pb"))
    return rows.select("iri", "change", place.alias("position"))


def entity_catalog(entities: DataFrame, instances: DataFrame, predicates: DataFrame, descendants: DataFrame) -> DataFrame:
    """Entities with instance, assertion and descendant counts.

    ``instances(class, instances)``, ``predicates(p, uses)``,
    ``descendants(iri, descendants)``.
    """
    return (entities.join(instances.select(F.col("class").alias("iri"), "instances"), "iri", "left")
            .join(predicates.select(F.col("p").alias("iri"), F.col("uses").alias("assertions")), "iri", "left")
            .join(descendants, "iri", "left").fillna(0, ["instances", "assertions", "descendants"]))


def context_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(iri, reason): first aspect of a class that changed between versions.

    Rows are ``(iri, aspect, value)`` with aspects label, comment, parents,
    definitions and ancestry.
    """
    order = ["label", "comment", "parents", "definitions", "ancestry"]

    def signed(d: DataFrame, name: str) -> DataFrame:
        return d.distinct().groupBy("iri", "aspect").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(_digest(["value"])).alias("d")).alias(name))

    rows = signed(old, "a").join(signed(new, "b"), ["iri", "aspect"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    rank = F.create_map(*[F.lit(x) for i, a in enumerate(order) for x in (a, i)])
    return rows.groupBy("iri").agg(F.min_by("aspect", rank[F.col("aspect")]).alias("reason"))


def latest_deltas(deltas: DataFrame) -> DataFrame:
    """The last delta of every statement ``(quad columns, op, seq)``."""
    last = F.max(F.struct("seq", "op", "pos"))
    return deltas.groupBy(*m.STATEMENT).agg(last.alias("d")).select(
        *m.STATEMENT, F.col("d.pos").alias("pos"), F.col("d.op").alias("op"), F.col("d.seq").cast("long").alias("seq"))


def apply_deltas(quads: DataFrame, deltas: DataFrame) -> DataFrame:
    """A batch of statement deltas (op add / remove) applied to a table."""
    last = latest_deltas(deltas)
    cond = m.same_statement(quads, last)
    kept = quads.join(last, cond, "left_anti")
    return kept.select(*m.QUAD_COLS).unionByName(last.filter("op = 'add'").select(*m.QUAD_COLS))


def apply_subject_updates(quads: DataFrame, updates: DataFrame, removed: DataFrame) -> DataFrame:
    """Replace whole subjects by ``updates`` (quads) and drop ``removed(s)``."""
    touched = updates.select("s").unionAll(removed.select("s")).distinct()
    return quads.join(touched, "s", "left_anti").select(*m.QUAD_COLS).unionByName(updates.select(*m.QUAD_COLS))


def write_table(quads: DataFrame, path: str) -> None:
    """Store quads as the first entries of a delta log: every row says which
    statement it sets, live or not, and the sequence number that did."""
    quads.select(*m.QUAD_COLS).withColumns({"live": F.lit(True), "seq": F.lit(-1).cast("long")}).write.mode("overwrite").parquet(path)


def read_table(spark, path: str) -> DataFrame:
    """The statements whose latest entry is live."""
    newest = F.max(F.struct("seq", "live", "pos")).alias("x")
    rows = spark.read.parquet(path).groupBy(*m.STATEMENT).agg(newest).filter("x.live")
    return rows.withColumn("pos", F.col("x.pos")).select(*m.QUAD_COLS)


def stream_deltas(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of deltas to a table made by ``write_table``.

    A batch adds its own latest entries and reads nothing.  The highest
    sequence number wins on reading, so late and retried batches give the same
    statements; ``write_table(read_table(...), other_path)`` compacts the log.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        rows = latest_deltas(batch).withColumn("live", F.col("op") == "add")
        rows.select(*m.QUAD_COLS, "live", "seq").write.mode("append").parquet(path)

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
