"""Time the headline queries; prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""
from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["local_grid", "dst_subhourly", "hourly_sum", "fact_dim_join", "merge_zone_hour", "training_table",
            "pivot_two_level", "unavailability", "hour_profile", "modal_step", "ffill_zone", "lag_block", "volatility_24h",
            "hourly_features", "hourly_extras", "daily_matrix_diff", "daily_matrix_wide", "origin_history",
            "multiwindow_experts", "expert_ols", "tune_window", "additive_model", "long_short_pair", "error_table",
            "dm_statistic", "cross_period_corr", "error_acf", "hill_index", "ewa_tune", "ewa_apply"]


def main() -> None:
    from hourgrid.plans.catalog import QUERIES
    from hourgrid.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "hourgrid-bench")
    names = sys.argv[1:] or HEADLINE
    QUERIES["hourly_sum"].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not counted
    seconds: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            QUERIES[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
