"""Warm run time of the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS, BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from riskloom.plans.catalogue import BACKTESTS, BLOCKS, PANELS, QUERIES, REPORTS
from riskloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    *REPORTS,
    *[n for n in BLOCKS if n in ("percent_rank_scaled", "ntile_scaled", "rolling_windows")],
    *[n for n in PANELS if n in ("features_events", "features_orders", "standardise")],
    *[n for n in BACKTESTS if n in ("bt_summary", "model_summary")],
    "fit_elastic_net",
]


def run(spark, name: str) -> float:
    """Seconds to compute every row; the noop sink keeps the driver out of it."""
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = local_session(CPUS, shuffle_partitions=max(8, int(CPUS)))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name)  # warm-up
        seconds[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "warm_seconds_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": CPUS,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
