"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the local cores.  Each query runs once to warm up and then
BENCH_RUNS times (default 2); its figure is the median.  Every row of the
result is computed and thrown away, nothing is collected.  Where the tables of
a tenth of the size lie beside them, ``growth`` has one run on those too, so
that the cost of more rows can be told from the cost of starting jobs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from echofield.plans import catalog
from echofield.session import local_session

HEADLINE = [
    "step_metrics", "population_summary", "gini", "rank_percentile", "describe_table", "transition_matrix",
    "edges_from_sequence", "degree_histogram", "neighbor_activity", "neighbor_mean", "local_clustering",
    "random_edges", "preferential_edges", "rewire_edges", "sampled_exposures", "blend_scores", "affect_update",
    "class_transition", "fatigue_update", "fold_fatigue", "top_k_items", "selection_agreement", "ks_two_sample",
    "anova_oneway", "pairwise_ttests", "bootstrap_band", "abc_distance", "sobol_total", "check_params",
    "box_stats", "sobol_confidence", "cold_start", "explore_mix", "stream_fold", "read_snapshots",
    "edge_affect_distance", "edges_from_shared", "rewire_edges_settled",
    "quantiles_from_sketches", "saltelli_design_sobol", "fatigue_update_bucketed",
]
SMALLER = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}


def run(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    catalog.all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, "echofield-bench")
    spark.sparkContext.setLogLevel("ERROR")
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    at, size = os.path.split(sf_dir.rstrip("/"))
    small = os.path.join(at, SMALLER.get(size, ""))
    times, growth = {}, {}
    for name in only or HEADLINE:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        if size in SMALLER and os.path.isdir(small):
            growth[name] = round(run(spark, name, small), 3)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": size, "cores": int(cores), "runs": runs,
        "growth": {"sf": SMALLER.get(size), "queries": growth},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
