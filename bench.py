"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables and ``BENCH_CPUS`` the local cores.
Each query runs in full twice and the faster run counts, so that compiling the
generated code is not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from checks.run import session  # noqa: E402

HEADLINES = [
    "env_wide", "nearest_place", "clean_pipeline", "scored_listings", "vec_knn_batch",
    "recommend", "tfidf", "text_knn", "embedding_pipeline", "distribution_report",
    "suite_results",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
