"""Time the headline queries: one warm-up over the smallest tables, then BENCH_RUNS timed runs each (one if unset) over BENCH_SF_DIR.

What is printed is the median of a query's runs; the graph of the tables is built once.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from loomgraph import catalog
from loomgraph.session import session
from loomgraph.sources.tables import clean, graph

HEADLINE = """callees_3hop callers_3hop callgraph_propose_edges spread_activation hebbian_update search_ranked related_by_pattern references_grouped namespace_summary
org_lift_edges shared_dependencies org_find_similar reconcile_full reconcile_incremental incremental_file_diff pending_dedup intent_verdict rule_evaluation resolve_candidates
semantic_verify debounce_sessions extract_python lift_python source_ranges""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = session(f"local[{cpus}]", "bench", int(cpus))
    warm = "/root/testdata/sf0.001"
    for name in HEADLINE[:2]:
        catalog.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    graph(spark, sf)
    took = {"index_graph": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        each = []
        for _ in range(runs):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - start)
        took[name] = round(median(each), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    clean(spark)
    spark.stop()


if __name__ == "__main__":
    main()
