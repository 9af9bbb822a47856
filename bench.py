"""Headline queries, timed end to end (planning and execution). Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from indicatrix import catalog  # noqa: E402
from indicatrix.session import build_session  # noqa: E402

HEADLINE = [
    "unemp_trend_ma12", "gdp_annual_summary", "gdp_growth_ranking", "credit_evolution", "deleveraging_episodes", "yield_spread", "inflation_price_index",
    "real_interest_rate", "debt_vs_gdp", "macro_dashboard_latest", "health_scorecard", "annual_snapshot", "transform_credit", "dense_customers",
    "customer_ranks", "user_days", "calendar_averages", "pillar_statistics", "correlation_levels", "trend_tests_monthly", "lead_lag_tests", "unit_roots",
    "quality_summary", "threshold_alerts", "peer_comparison", "ensemble_forecast", "scenario_combined", "briefing_headlines", "kpi_yoy", "upserted_orders",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executor threads before the clock runs
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
