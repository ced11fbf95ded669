"""Searches counted by groups of entities: the same counts as hits one by one, and no row per query and entity."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators import search as se
from quadrille.plans import search_queries as sq
from quadrille.plans.registry import Source
from test_findings_r03 import SF, part, same, tables


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Parts of few names and brands, with gaps between their keys."""
    rows = part(spark, [k for k in range(600) if k % 7]).withColumn("p_size", (F.col("p_partkey") % 50).cast("int"))
    return tables(spark, tmp_path_factory.mktemp("parts"), part=rows)


def found(spark, folder):
    q, names, tokens, rows = sq._found(Source(spark, folder))
    return q, names, tokens, rows


def copies(rows, n):
    """``n`` entities for each one."""
    return rows.withColumn("iri", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.col("iri"), F.lit("#"), i.cast("string")))))


@pytest.mark.parametrize("name", ["field_facets_and_remedies", "hits_per_field", "result_facets", "ranked_tiers", "match_evidence"])
def test_equal_to_sql(spark, parts, name):
    same(spark, parts, name)


def test_groups_do_not_grow_with_copies(spark, parts):
    """copies of an entity are counted in the row of their group."""
    from quadrille.operators.entities import base_kinds
    q, _, tokens, rows = found(spark, parts)
    kinds = base_kinds(q)
    rows, kinds = rows.localCheckpoint(), kinds.localCheckpoint()
    one = se.field_groups(tokens, rows, kinds)
    many = se.field_groups(tokens, copies(rows, 5), copies(kinds, 5))
    assert sorted(map(str, one.withColumn("n", 5 * F.col("n")).collect())) == sorted(map(str, many.collect()))
    plain = se.field_hits(tokens, *_listed(spark, parts)).join(kinds, "iri").filter("kind = 'Class'").groupBy("qid", "field").agg(F.countDistinct("iri").alias("hits"))
    assert sorted(map(tuple, se.field_facets(one, ["classes"]).collect())) == sorted(map(tuple, plain.collect()))


def _listed(spark, folder):
    _, _, _, index, _, matches = sq._matched(Source(spark, folder))
    return matches, index


def test_ranks_of_tiers(spark, parts):
    """ranks from counts are those of the sorted hits."""
    _, names, _, index, tokens, matches = sq._matched(Source(spark, parts))
    ranked = se.rank_lexical(se.lexical_score(tokens, matches, index), tokens, names, ascii_only=True)
    want = ranked.groupBy("qid", "tier", "coverage").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))
    got = se.tier_ranks(tokens, found(spark, parts)[3], names, ascii_only=True).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_evidence_of_some_hits(spark):
    """the best field of a query's own words, by field order, name and value; only of the hits asked for."""
    schema = "iri string, field string, value string, token string, how string"
    rows = spark.createDataFrame([("a", "p", "red b", "red", "exact"), ("a", "p", "red a", "red", "exact"), ("a", "$alias", "Ring", "ring", "fuzzy"),
                                  ("a", "$label", "rod", "rod", "exact"), ("b", "$iri", "red", "red", "exact")], schema)
    tokens = spark.createDataFrame([("q1", "red"), ("q1", "ring"), ("q2", "red"), ("q2", "none"), ("q3", "rod")], "qid string, token string")
    got = sorted(map(tuple, se.match_evidence(tokens, rows).collect()))
    assert got == [("q1", "a", "name", "Ring"), ("q1", "b", "iri", "red"), ("q2", "a", "p", "red a"), ("q2", "b", "iri", "red"), ("q3", "a", "name", "rod")]
    hits = spark.createDataFrame([("q2", "b")], "qid string, iri string")
    assert list(map(tuple, se.match_evidence(tokens, rows, hits).collect())) == [("q2", "b", "iri", "red")]
