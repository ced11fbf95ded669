"""Shorthands shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille import model as m
from quadrille.plans.datasets import EX

TYPE, LABEL, SUBCLASS, SEE_ALSO, COMMENT, CLASS = m.TYPE, m.LABEL, m.SUBCLASS, m.SEE_ALSO, m.COMMENT, m.CLASS
TOTAL, REF, STATUS, BUYER, NATION = EX + "total", EX + "orderRef", EX + "status", EX + "orderedBy", EX + "fromNation"
BALANCE, SEGMENT, PRIORITY, DATE, REGION = EX + "balance", EX + "segment", EX + "priority", EX + "orderDate", EX + "inRegion"
XSD = m.XSD


def lex(df: DataFrame, *names: str) -> DataFrame:
    """Lexical forms of term columns under their own names."""
    return df.select(*[F.col(n)["value"].alias(n) for n in (names or df.columns)])


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
