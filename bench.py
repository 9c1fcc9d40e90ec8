"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed $BENCH_RUNS times (median); caches
are cleared in between, so nothing is carried from one run to the next.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roundwise.plans.catalogue import QUERIES  # noqa: E402
from roundwise.session import local_session  # noqa: E402

HEADLINES = [
    "person_time",
    "attach_demographics",
    "rate_by_sex",
    "rate_table_3level",
    "prevalence_wald",
    "cohort_flow",
    "rate_trend_factor",
    "logit_trend_by_band",
    "smooth_curves",
    "infections_averted",
    "parameter_quantiles",
    "numeric_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
