"""op5_minhash_classes: sets of documents with a partner are found without a shuffle of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.llm import near_dedup


def _docs(spark):
    r = random.Random(3)
    base = [" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(40)]
    rows = [(2**53 + 1 + i, base[i % 40] + (" z" * (i // 40))) for i in range(80)] + [(None, base[0]), (1, None), (2, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), {2**53 + 1 + i: 2**53 + 1 + i % 40 for i in range(80)} | {1: 1, 2: 2}


@pytest.mark.parametrize("buckets", [512, 1])
def test_sets_are_found_without_a_shuffle_of_texts(spark, monkeypatch, buckets):
    plans, real = {}, near_dedup.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(near_dedup, "written", seen)
    monkeypatch.setattr(near_dedup, "SIEVE_BUCKETS", buckets, raising=False)
    docs, want = _docs(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs, near_dedup.Banding(words=4)).filter("doc_id IS NOT NULL").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want
    assert "Exchange" not in plans["near-sets"]


def test_ids_whose_bits_meet_lose_no_set(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SIEVE_BUCKETS", 1)
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id")).alias("text"))
    members = docs.filter("doc_id % 100 = 0").select("doc_id")
    found = near_dedup._sets_of(docs, members, near_dedup.Banding(words=4))
    assert members.join(found, members["doc_id"] == found["id"], "left_anti").count() == 0
    assert 1000 < found.count() < 10_000
