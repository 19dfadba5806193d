"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quern.registry import all_queries
from quern.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = [
    "filtered_topk_cosine", "exact_topk_l2", "batch_knn", "ivf_probe_search", "ivf_davies_bouldin", "bm25_topk", "bm25_batch", "hybrid_rrf",
    "json_filter_and_or_not", "route_ewma", "route_confidence", "latency_percentiles_all", "jaccard_gate", "changelog_latest_wins", "dedup_stats",
    "delta_stats", "int8_quantize", "evidence_map", "verify_claims", "memory_contradiction", "fk_cascade_delete", "denormalize",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = session(f"local[{CPUS}]", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(sorted(took[1:])[(RUNS - 1) // 2], 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
