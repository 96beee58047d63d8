"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is run to the end without keeping its rows; a key's time is the
median of its runs after a warm-up. Batched calls also report calls a second,
and the load rate is that of rewriting all edges sorted as lists are read.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from tessera.operators.graph import PropertyGraph
from tessera.plans import registry
from tessera.session import get_spark
from tessera.sources.derived import edges

HEADLINE = [
    "get_attribute", "get_neighbors_atype", "get_neighbors_attr_batch", "get_nodes2", "obj_get",
    "assoc_range", "assoc_range_wildcard", "assoc_range_batch", "assoc_get_batch", "assoc_count_batch", "assoc_time_range_wildcard", "assoc_time_range_batch",
    "assoc_range_merged", "lb_add_link", "lb_get_link_list", "lb_count_links", "lb_count_table", "latency_summary", "latency_histogram", "connected_components", "bfs_levels",
]
BATCHES = {"assoc_range_batch": "requests", "assoc_count_batch": "requests", "assoc_time_range_batch": "requests"}
RUNS = 3


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    times, spread = {}, {}
    for key in HEADLINE:
        run = lambda key=key: found[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        runs = sorted(timed(run) for _ in range(RUNS))
        times[key] = round(statistics.median(runs), 4)
        spread[key] = {"p50": times[key], "max": round(runs[-1], 4)}
    n_requests = registry._list_requests(spark, sf_dir).count()
    with tempfile.TemporaryDirectory() as folder:
        graph = PropertyGraph(edges(spark, sf_dir))
        n_edges = graph.edges.count()
        load = timed(lambda: graph.compact(f"{folder}/edges"))
    out = {"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    out |= {"spread": spread, "batch_calls": n_requests, "calls_per_sec": {k: round(n_requests / times[k]) for k in BATCHES}, "load_edges_per_sec": round(n_edges / load)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
