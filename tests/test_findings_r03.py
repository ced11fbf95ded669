"""Queries on small tables of the shapes that the third review named, against their SQL or plain versions."""

import os

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from quadrille.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def tables(spark, folder, **changed):
    """A folder with the tables of sf0.001, some of them replaced."""
    for name in os.listdir(SF):
        if name[:-8] not in changed:
            os.symlink(f"{SF}/{name}", folder / name)
    for name, df in changed.items():
        df.toPandas().to_parquet(folder / f"{name}.parquet")
    return str(folder)


def part(spark, keys):
    """The part table stretched to other keys, its rows in turn."""
    rows = spark.read.parquet(f"{SF}/part.parquet")
    own = spark.createDataFrame([(k,) for k in keys], "k long")
    return own.withColumn("p_partkey", F.col("k") % rows.count()).join(rows, "p_partkey").withColumn(
        "p_partkey", F.col("k")).select(*rows.columns)


def same(spark, folder, name):
    assert compare(spark, connect(folder), QUERIES[name], folder) is None


def test_detected_formats_of_cut_characters(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(10).withColumn(
        "html", F.concat(F.repeat(F.lit("x"), (F.col("page_id") % 4).cast("int")), F.repeat(F.lit("é€"), 3000)))
    same(spark, tables(spark, tmp_path, pages=pages), "detected_formats")


def test_moved_classes_nested_three_deep(spark, tmp_path):
    rows = part(spark, range(400)).withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, 5).otherwise(F.col("p_size")).cast("int"))
    same(spark, tables(spark, tmp_path, part=rows), "moved_classes")


def test_neighbours_beyond_four_thousand(spark, tmp_path):
    rows = part(spark, range(4100)).withColumn("p_brand", F.lit("Brand#7"))
    same(spark, tables(spark, tmp_path, part=rows), "neighbours_of_brand")


def test_components_through_undeclared_parents(spark, tmp_path):
    rows = part(spark, [k for k in range(9900, 10200) if k % 7 in (1, 2, 5, 6)])
    same(spark, tables(spark, tmp_path, part=rows), "quality_structure_component")


def test_spans_of_a_word_in_many_rules(spark):
    """A line of 3,000 tokens and 2,000 rules for each second one: tokens are not paired with rules."""
    from quadrille.operators import textmatch as tm
    docs = spark.createDataFrame([(2**53 + 1, "alpha beta7 " * 1500), (None, "beta3, alpha"), (3, None)], "doc_id long, text string")
    rules = spark.createDataFrame([(f"c{i}", f"alpha+beta{i}") for i in range(2000)] + [("c70", "beta7+Alpha")], "canonical string, alias string")
    found = tm.match_nested(tm.tokenize(docs), rules, slices=True)
    got = tm.span_offsets(found, docs).filter("sound").groupBy("doc_id", "canonical", "slice").count().collect()
    assert sorted(map(tuple, got), key=str) == [(2**53 + 1, "c7", "alpha beta7", 1500), (None, "c3", "beta3, alpha", 1)]


@pytest.mark.parametrize("name", ["same_term_pairs", "theta_join_on_sum", "compatible_join_with_unbound", "name_collisions"])
def test_hot_keys_are_dealt_in_blocks(spark, tmp_path, monkeypatch, name):
    """Blocks of seven rows give the same pairs, and no task holds a whole key."""
    from quadrille.operators import patterns as pt
    monkeypatch.setattr(pt, "BLOCK_ROWS", 7)
    monkeypatch.setattr(pt, "TASK_PAIRS", 100)
    same(spark, SF, name)
    assert pt.block_join(spark.range(64).selectExpr("id a", "1 k"), spark.range(64).selectExpr("id b", "1 k"), ["k"]).withColumn(
        "task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0] < 4096 // 4


def test_intersections_of_a_name_of_many_classes(spark, monkeypatch):
    """Pairs are ranked per name: 400 classes do not multiply them; those below a class are left out."""
    from quadrille.operators import suggest as sg
    largest, plain = [], sg.cut
    monkeypatch.setattr(sg, "cut", lambda df: (largest.append(df.count()), plain(df))[1])
    names = [(f"n{i:03d}", "red big bolt") for i in range(400)] + [(f"{p}{i:02d}", w) for p, w in (("a", "red big"), ("b", "big bolt")) for i in range(60)]
    below = [(f"b{i:02d}", "n000") for i in range(59)] + [("a00", "n001")]
    got = sg.intersection_candidates(spark.createDataFrame(names, "iri string, label string"), spark.createDataFrame(below, "src string, dst string")).collect()
    found = {}
    for r in got:
        found.setdefault(r["iri"], []).append((r["rank"], r["first"], r["second"]))
    first = [(k + 1, "a00", f"b{k:02d}") for k in range(12)]
    assert len(found) == 400 and sorted(found["n002"]) == first
    assert sorted(found["n000"]) == [(k + 1, f"a{k:02d}", "b59") for k in range(12)]
    assert sorted(found["n001"]) == [(k, "a01", b) for k, _, b in first] and max(largest) < 100_000


@pytest.mark.parametrize("hops", [1, 3, 12])
def test_paths_by_levels(spark, hops):
    """Trees, rings and a self-loop against a plain walk; a level holds a shared parent once."""
    from quadrille.operators import aggregates as ag
    up = {f"n{i:02d}": f"n{i // 3:02d}" for i in range(1, 60)} | {"n00": "top", "r0": "r1", "r1": "r2", "r2": "r0", "s": "r1", "x": "x"}
    want = set()
    for node in up:
        path, cycle, at = [node], False, node
        for _ in range(hops):
            if at not in up or up[at] in path:
                cycle = cycle or at in up
                break
            at = up[at]
            path.append(at)
        want.add((node, tuple(path), cycle))
    rows = spark.createDataFrame([(a, b, "") for a, b in up.items()], "iri string, parent string, parent_label string")
    out = ag.entity_paths(rows, hops)
    assert {(r["iri"], tuple(r["path"]), r["cycle"]) for r in out.collect()} == want


def test_buckets_grow_with_the_statements(spark, monkeypatch):
    from quadrille.plans.datasets import quads
    from quadrille.sources import store
    monkeypatch.setattr(store, "BUCKET_ROWS", 50)
    st = store.save(quads(spark, SF, "customers").coalesce(1), buckets=2, rows=750)
    files = [r["f"] for r in st.by_subject.filter(F.col("p").endswith("label")).select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) > 2 and st.quads.count() == quads(spark, SF, "customers").count()


def test_validated_synonyms_without_broadcast(spark):
    """Names are not sent through the driver; the verdicts stay."""
    same(spark, SF, "validated_synonyms")
    df = QUERIES["validated_synonyms"].run(spark, SF)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
