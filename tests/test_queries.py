"""Registered queries against their SQL forms on the smallest tables; tools/check_oracle.py runs all of them at any size."""

import importlib.util
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF_DIR = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check_oracle", ROOT / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
sys.modules["check_oracle"] = check
spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")
SAMPLE = ["gdp_growth_ranking", "unemp_trend_ma12", "deleveraging_episodes", "credit_to_gdp", "health_scorecard", "annual_snapshot", "transform_credit", "dense_customers",
          "customer_ranks", "policy_steps", "pillar_summaries", "period_pairwise", "correlation_levels", "quality_summary", "threshold_alerts", "peer_comparison",
          "ensemble_forecast", "scenario_consolidation", "briefing_tone", "kpi_yoy", "chart_growth_monthly", "positional_payload", "upserted_orders",
          "unit_roots", "correlation_matrix", "phillips_band", "seasonal_forecast", "order_search_forecast", "ensemble_status", "lineage_records", "drift_check", "key_checks", "freshness_checks", "extracted_pillars", "page_digests", "upserted_partitions", "customer_comparison", "customer_rank_history", "scenario_report", "correlation_report", "significance_report"]


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    from indicatrix import catalog

    result = check.compare(catalog.queries()[name](spark, SF_DIR), con, catalog.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
