"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from storyloom.plans.queries import QUERIES
from storyloom.session import local_session

HEADLINE = (
    "s01_feed_items",
    "s07_article_rows",
    "t10_simhash",
    "d03_near_pairs",
    "d06_accept_articles",
    "e01_hash_embedding",
    "c02_cluster_articles",
    "c06_recluster",
    "q01_postings",
    "q06_page",
    "a02_run_alerts",
    "v01_recent_articles",
    "v04_story_page",
    "v08_lead_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    spark = local_session(cores, "storyloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {[round(r, 2) for r in runs]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries (median of repeats)",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "repeats": repeats,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
