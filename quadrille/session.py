"""Session-level helpers: lineage cuts for iterative plans and global row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def local_session(cores: str = "*", app: str = "quadrille") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _checkpoint_folder(spark: SparkSession) -> None:
    """Point the context at the shared folder named by the session.

    Only a local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, since executors could not share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, for tables an operator writes and reads back."""
    _checkpoint_folder(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and drop its lineage.

    Iterative operators call this once a round, so a lost executor re-reads
    the last round instead of replaying the whole loop.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Like ``cut``, but nothing of the old plan stays: a checkpoint hands down
    constraints and orderings, which grow with every self-join of a doubling
    loop until planning takes longer than the work.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input (fewer splits than cores, such as one file with one
    row group) enough tasks for CPU-heavy work; large inputs pass unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles and merges.

    The size of a side is estimated from compressed files, so a planner may
    broadcast tables of many times the limit through the driver.  For sides
    that grow with the input.
    """
    return df.hint("merge")


def global_index(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """Number all rows from 0 in ``order`` without a single-task window.

    The range sort numbers rows inside each partition; only the per-partition
    counts (one row per partition) are summed globally.  ``order`` must break
    ties.
    """
    # a checkpointed sort is evaluated once, so ids and counts agree
    ranked = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranked = (ranked.withColumn("_part", F.shiftright("_id", 33))
              .withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)))
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return (ranked.join(starts, "_part")
            .withColumn(name, F.col("_start") + F.col("_at"))
            .drop("_part", "_at", "_id", "_start"))


def group_index(df: DataFrame, keys: list[str], order: list[Column], name: str = "item") -> DataFrame:
    """Number rows from 1 inside each group, safe for groups of any size.

    A window would send a whole group to one task.  Here the range sort splits
    a hot group over many partitions and the group's first global index is
    subtracted.
    """
    rows = global_index(df, [F.col(k) for k in keys] + order, "_global")
    starts = rows.groupBy(*keys).agg(F.min("_global").alias("_first"))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = [rows[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(keys)]
    out = rows.join(starts, same)
    return (out.withColumn(name, F.col("_global") - F.col("_first") + 1)
            .drop("_global", "_first", *[f"_k{i}" for i in range(len(keys))]))
