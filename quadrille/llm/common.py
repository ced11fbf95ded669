"""Helpers shared by the operators: column choice, tables, lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.session import cut, shared_folder

__all__ = ["by_text_id", "col", "cut", "fresh_path", "pick", "table", "written"]


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the names an operator works with.

    Operators begin with this, so further columns of ``df``, whatever they are
    called, cannot clash with their own.
    """
    return df.select(*[col(source).alias(own) for own, source in names.items()])


def by_text_id(df: DataFrame, fn: Callable, schema: str, key: str) -> DataFrame:
    """``mapInPandas`` with the integer column ``key`` as text on both ways.

    pandas turns integers beside a null into doubles, which rounds ids above
    2**53; ``schema`` declares the column as a string.
    """
    out = df.withColumn(key, F.col(key).cast("string")).mapInPandas(fn, schema)
    return out.withColumn(key, F.col(key).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: later reads
    prune columns and a lost executor costs a re-read only."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
