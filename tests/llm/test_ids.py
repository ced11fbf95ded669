"""Ids above 2**53 beside nulls come back unchanged from every Python worker."""

import public_tokenizers
import pytest

from quadrille.llm import decontaminate, html_text, near_dedup, personal_data, token_output
from quadrille.llm.common import fresh_path

IDS = [None, 2 ** 53 + 1, 2 ** 63 - 1, -(2 ** 63), 7]
TEXT = "mail a.b@c.example.org now " + " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, TEXT) for i in IDS], "doc_id long, text string").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=str)


def test_ids_pass_unchanged(spark, docs):
    want = sorted(IDS, key=str)
    items = spark.createDataFrame([(2 ** 53 + 3, TEXT)], "item_id long, text string")
    leaks = decontaminate.leaks(docs, items)
    assert ids(leaks) == want and {r["item_id"] for r in leaks.collect()} == {2 ** 53 + 3}
    assert ids(personal_data.found(docs)) == want
    pages = docs.selectExpr("doc_id AS page_id", "'' AS url", "text AS html")
    assert ids(html_text.extracted(pages), "page_id") == want
    path = fresh_path(spark, "ids")
    token_output.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert ids(token_output.summary(spark, path)) == ids(token_output.documents(spark, path)) == want
    classes = near_dedup.classes(docs)
    assert ids(classes) == want
    assert {r["component_id"] for r in classes.collect() if r["doc_id"] is not None} == {-(2 ** 63)}
