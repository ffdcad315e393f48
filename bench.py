"""Benchmark the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through a ``noop`` sink (every row is
computed, nothing is collected to the driver).  A small warm-up query runs
first so JVM start-up is not charged to the first headline query.
"""

from __future__ import annotations

import json
import os
import platform
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "blocked_levenshtein_best",   # reference: 1 h (trigram index + process pool)
    "jaro_winkler_best",          # reference: 2 h (all pairs)
    "levenshtein_best",           # reference: 11 h (all pairs)
    "tfidf_context",              # reference: < 10 s
    "bigram_cosine_best",
    "embedding_pairs",
    "token_set_matches",
    "budget_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from namespotter.session import local_session
    from namespotter.plans.catalog import QUERIES

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="namespotter-bench")
    QUERIES["trigram_index"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up

    times = {}
    for q in names:
        t0 = time.perf_counter()
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.perf_counter() - t0, 3)
        print(f"{q}: {times[q]}s", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus,
                      "machine": f"{platform.machine()} {os.cpu_count()} cores, local[{cpus}]"}))


if __name__ == "__main__":
    main()
