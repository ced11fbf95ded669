"""Registered queries against their SQL twins; a sample unless ORACLE=all."""

import os

import pytest

from oracle import compare, connect
from quadrille.plans.catalogue import QUERIES

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "expensive_open_orders", "compatible_join_with_unbound", "minus_with_unbound", "order_totals_by_status",
    "graph_variable_aggregate", "minted_part_iris", "modify_statuses", "closure_through_cycles", "nodes_on_cycles",
    "connected_components", "conjunction_members", "density_clusters", "quality_label_duplicate", "matched_terms",
    "subclass_candidates", "single_word_matches", "three_way_merge", "applied_deltas", "ntriples_round_trip", "casts",
]
NAMES = list(QUERIES) if os.environ.get("ORACLE") == "all" else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], SF) is None
