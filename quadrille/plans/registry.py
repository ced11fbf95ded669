"""Named queries: an operator applied to the driver tables, with its ANSI SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quadrille.plans import datasets as d
from quadrille.sources import store


@dataclass(frozen=True)
class Query:
    ids: tuple[str, ...]
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    module: str = ""


QUERIES: dict[str, Query] = {}

#: datasets stored by this process: (application, folder, dataset) to its tables
STORED: dict[tuple[str, str, str], store.Store] = {}


class Source:
    """What a query sees: the session, the tables and the derived quads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return d.table(self.spark, self.sf_dir, name)

    def quads(self, *names: str) -> DataFrame:
        """The virtual quads: right for patterns that bind the predicate."""
        return d.quads(self.spark, self.sf_dir, *names)

    def stored(self, *names: str) -> store.Store:
        """The quads as stored tables, written on first use by the application:
        right for look-ups, star joins and operators that scan them several
        times or in every round of a loop."""
        parts = []
        for name in names:
            key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
            if key not in STORED:
                STORED[key] = store.save(self.quads(name), rows=d.expected_rows(self.spark, self.sf_dir, name))
            parts.append(STORED[key])
        return reduce(store.Store.union, parts)

    def loaded(self, *names: str) -> DataFrame:
        return self.stored(*names).quads


def query(ids: str, name: str, sql: str | None = None, data: str = ""):
    """Register ``fn(Source) -> DataFrame``; ``data`` names the datasets that
    the SQL sees as ``quads``.  SQL text may open with ``WITH``."""

    def wrap(fn: Callable[[Source], DataFrame]):
        text = sql
        if sql is not None:
            body = sql.strip()
            if data:
                head = f"WITH RECURSIVE quads AS MATERIALIZED ({d.quads_sql(*data.split())})"
                body = (head + ", " + body[5:]) if body[:5].upper() == "WITH " else f"{head} {body}"
            # engines may evaluate a cast before the filter that protects it
            text = re.sub(r"(?<![_\w])cast\(", "try_cast(", body)
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(tuple(ids.split()), name,
                              lambda spark, sf_dir: fn(Source(spark, sf_dir)), text,
                              fn.__module__.rsplit(".", 1)[-1])
        return fn

    return wrap
