"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES (comma separated) choose
the input, the cores and the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quadrat.catalog import QUERIES  # noqa: E402
from quadrat.session import local_session  # noqa: E402

HEADLINE = [
    "focal_rate_change", "zero_fill_focal", "conditional_sum_keep_zero", "canopy_left_join", "dedup_samples", "unique_join",
    "masked_columns", "zone_assignment", "net_standing", "basal_area_wide", "zone_weighted_mean", "distinct_area_sum",
    "integrate_campaigns", "period_collapse", "box_stats", "box_stats_price", "linear_trend", "cor_matrix", "pairs_table",
    "adjusted_rates", "poisson_glm", "overdispersion", "path_coefs", "nb2_glm", "glmm_gaussian",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "quadrat-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["visit_year"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
