"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local cores.
Every query runs once to warm up, then ``BENCH_RUNS`` times; its whole result goes to the noop sink
and the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from hourlake.queries import QUERIES
from hourlake.session import build_session

HEADLINE = [
    "demand_headline",
    "demand_rollup_hourly",
    "demand_rollup_daily",
    "fact_demand_hourly",
    "demand_recent",
    "generation_mix_recent",
    "renewable_share",
    "generation_share",
    "interchange_flows",
    "mirror_pairs",
    "zone_summary",
    "forecast_accuracy",
    "seasonal_ar1_forecast",
    "seasonal_naive_forecast",
    "anomaly_scan",
    "generation_mix_shift",
    "lags_by_rows",
    "rolling_mean",
    "interpolate_in_time",
    "latest_per_key",
    "top_zones_and_other",
    "fuel_band_series",
    "trim_incomplete_tail",
    "energy_balance",
    "fuel_reconciliation",
    "validation_report",
    "source_priority",
    "region_pages_to_demand",
    "hourly_forecast_documents",
    "upsert_overlapping_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "hourlake-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        measured = []
        for i in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                measured.append(time.perf_counter() - started)
        times[name] = round(statistics.median(measured), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_median_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
