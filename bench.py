"""Headline queries, timed end to end; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quadrille.plans.catalogue import QUERIES  # noqa: E402
from quadrille.plans.registry import Source  # noqa: E402
from quadrille.session import local_session  # noqa: E402

# the reference numbers each query stands next to are listed in README.md
HEADLINE = [
    "expensive_open_orders",          # filter, order, limit
    "order_buyer_nation_region",      # four-pattern join
    "subquery_best_order",            # aggregate joined back
    "order_table_filter",             # substring filter over fact rows
    "orders_sorted_by_price",         # fact sort
    "neighbours_of_brand",            # adjacency of one class
    "graph_catalogue",                # whole-graph metrics
    "class_closure",                  # transitive closure
    "connected_components",
    "sparsity_scores",
    "entity_kinds",                   # projection
    "quality_label_missing",          # quality scan, one grouped pass
    "ranked_tiers",                   # search index and ranking for a query batch
    "vector_comparison",
    "subclass_candidates",
    "phrase_matches_longest_first",   # dictionary matching over documents
    "three_way_merge",
    "applied_deltas",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_by_predicate_and_object"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm the JVM
    times = {}
    start = time.time()
    # the datasets that the queries below keep as stored quads, written once
    for dataset in ("orders", "customers", "geo", "catalog", "rings"):
        Source(spark, sf_dir).stored(dataset)
    times["store_datasets"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
