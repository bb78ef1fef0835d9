"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the threads.
Each query is run in full (every row and column is produced and thrown away).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.all import REGISTRY  # noqa: E402
from weekcast.session import build_session  # noqa: E402

# The registered queries that stand for the published timings.
HEADLINE = (
    "b7_panel_with_price",
    "b3_weekly_sku",
    "b6_dense_sku_coverage",
    "d1_segments_category",
    "d1_segments_sku",
    "c13_supervised_category",
    "w1_rolling_windows",
    "e1_series_summary_sku",
    "e9_sku_ranking",
    "e12_autocorrelation_sku",
    "g1_naive",
    "g2_seasonal_naive",
    "g3_holt",
    "g4_ridge",
    "g7_backtest_all_models",
    "g9_ridge_final_fit",
    "g12_scenario_baselines",
    "g12_scenario_ridge",
    "h5_metrics_by_horizon",
    "h8_rolling_vs_holdout",
    "h10_error_cases",
    "h11_bootstrap_wape",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "weekcast-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        start = time.perf_counter()
        REGISTRY.queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
