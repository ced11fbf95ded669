"""Ordering, slicing, paging and result caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille import model as m
from quadrille.functions import terms as t, text as tx
from quadrille.session import global_index


def order_by(df: DataFrame, *keys: tuple[Column, str]) -> DataFrame:
    """ORDER BY in term order; each key is ``(term, 'asc' | 'desc')``."""
    return df.orderBy(*[t.order_key(c).desc() if d == "desc" else t.order_key(c).asc() for c, d in keys])


def slice_(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def cell_text(c: Column) -> Column:
    """Display text of a term: prefixed IRI, else the lexical form."""
    return F.when(c["kind"] == "iri", tx.compact_iri(c["value"])).otherwise(c["value"])


def grid_keys(c: Column, direction: str = "asc", tie: str = "pos") -> list[Column]:
    """Grid order: numbers by value, others by text, unbound last both ways."""
    number, text = t.double_value(c), cell_text(c)
    desc = direction == "desc"
    turn = (lambda x: x.desc()) if desc else (lambda x: x.asc())
    return [c.isNull().asc(), turn(number.isNull()), turn(number), turn(text), F.col(tie).asc()]


def grid_sort(df: DataFrame, col: str, direction: str = "asc", tie: str = "pos") -> DataFrame:
    return df.orderBy(*grid_keys(F.col(col), direction, tie))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset+limit`` with the offset clamped to the last page."""
    total = df.count()
    start = min(max(0, offset), max(0, (total - 1) // limit * limit))
    return df.orderBy(*order).offset(start).limit(limit)


def page_of(df: DataFrame, order: list[Column], limit: int, reveal: Column) -> DataFrame:
    """The page that holds the row for which ``reveal`` is true."""
    rows = global_index(df, order, "row_index")
    target = rows.filter(reveal).agg(F.min("row_index")).scalar()
    number = F.floor(F.col("row_index") / limit)
    return rows.filter(number == F.coalesce(F.floor(target / limit), F.lit(0)))


TABLE_KEYS = {"iri": "o_orderkey", "status": "o_orderstatus", "price": "o_totalprice", "ts": "o_orderdate",
              "priority": "o_orderpriority", "customer": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"}


def table_sort(df: DataFrame, key: str, direction: int = 1, index: str = "o_orderkey") -> DataFrame:
    """Sort a fact table on one of its keys; ties keep the index order."""
    col = F.col(TABLE_KEYS.get(key, TABLE_KEYS["iri"]))
    return df.orderBy(col.asc() if direction == 1 else col.desc(), F.col(index).asc())


def individual_sort(rows: DataFrame, key: str, numeric: bool = False, direction: int = 1) -> DataFrame:
    """Order pivoted individuals by the first value of one column; rows
    without a value come last and ties fall back to the local name."""
    first = F.element_at(F.col("values")[key], 1)
    shown = F.when(first != "", first)
    value = shown.try_cast("double") if numeric else F.lower(shown)
    name = tx.local_name(F.col("iri"))
    return rows.orderBy(shown.isNull().asc(), value.asc() if direction == 1 else value.desc(), F.lower(name), name)


def cap(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` solutions plus the flag whether more existed."""
    extra = df.limit(n + 1)
    capped = extra.agg(F.count(F.lit(1)) > n).scalar()
    return extra.limit(n).withColumn("capped", capped)
