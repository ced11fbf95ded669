"""Vectors stay out of the driver: the fourth review, finding F1."""

from pyspark.sql import functions as F

from quadrille.llm import hard_negatives
from quadrille.llm.common import table

SF = "/root/testdata/sf0.01"


def test_no_vector_is_broadcast(spark, monkeypatch):
    """Trees were sent to all tasks once per block, through the driver."""
    plans, plain = [], hard_negatives.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(hard_negatives, "written", noted)
    small = hard_negatives.Mining(tree_size=3, block_rows=100)
    few = hard_negatives.mined(table(spark, SF, "embeddings"), F.col("vec_id") % 50 == 0, small)
    plans.append(few._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 4 and not any("Broadcast" in p for p in plans)
    whole = hard_negatives.mined(table(spark, SF, "embeddings"), F.col("vec_id") % 50 == 0)
    assert sorted(few.collect()) == sorted(whole.collect())
