"""DuckDB forms of the summary queries."""

from __future__ import annotations

from indicatrix.oracle.base import CENTS, facts
from indicatrix.oracle.statistics import annual
from indicatrix.plans.economy import CRISIS_WINDOWS
from indicatrix.plans.statistics import PRIMARY
from indicatrix.plans.summaries import DERIVED, INDICATORS
from indicatrix.registry import PILLARS

QUARTERLY = [c for p in PILLARS.values() if p.grain == "quarter" for c in p.columns if c in INDICATORS]
MONTHLY = [c for c in INDICATORS if c not in QUARTERLY]
FULL = f"""fp AS (SELECT * FROM (UNPIVOT (SELECT entity, period_start, {", ".join(MONTHLY)}, youth_unemployment_rate - unemployment_rate AS youth_gap,
    hicp - core_inflation AS core_headline_gap, ecb_main_refinancing_rate - hicp AS real_rate FROM monthly) ON {", ".join(MONTHLY + DERIVED)}
    INTO NAME indicator VALUE "value")
  UNION ALL SELECT * FROM (UNPIVOT (SELECT entity, period_start, {", ".join(QUARTERLY)} FROM quarterly) ON {", ".join(QUARTERLY)} INTO NAME indicator VALUE "value"))"""


def describe(by: str, v: str, source: str) -> str:
    return f"""SELECT {by}, count({v}) AS count, round(avg({v}), 4) AS mean, round(median({v}), 4) AS median,
  round(CASE WHEN count({v}) > 1 THEN stddev_samp({v}) END, 4) AS std, round(min({v}), 4) AS min, round(max({v}), 4) AS max,
  round(CASE WHEN count({v}) > 2 AND stddev_pop({v}) > 1e-12 THEN skewness({v}) WHEN count({v}) > 2 THEN 0 END, 4) AS skewness
FROM {source} WHERE {v} IS NOT NULL GROUP BY {by}"""


GROWN = """gr AS (SELECT *, ("value" - lag("value") OVER w) / NULLIF(lag("value") OVER w, 0) * 100.0::DOUBLE AS growth_pct,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY entity, indicator) AS n FROM ap WINDOW w AS (PARTITION BY entity, indicator ORDER BY year))"""
SHIFT = """(avg("value") FILTER (i > n // 2) - avg("value") FILTER (i <= n // 2)) / NULLIF(abs(avg("value") FILTER (i <= n // 2)), 0) * 100.0::DOUBLE"""
SUMMARY = f"""SELECT entity, indicator, min(year) AS earliest_year, max(year) AS latest_year, arg_min("value", year) AS earliest_value,
  arg_max("value", year) AS latest_value, avg("value") AS mean, stddev_samp("value") AS std, max("value") AS peak_value,
  arg_max(year, "value") AS peak_year, min("value") AS trough_value, arg_min(year, "value") AS trough_year, coalesce({SHIFT}, 0) AS pct_shift_halves,
  coalesce((arg_max("value", year) - arg_min("value", year)) / NULLIF(abs(arg_min("value", year)), 0) * 100.0::DOUBLE, 0) AS overall_change_pct,
  arg_max(growth_pct, year) FILTER (growth_pct IS NOT NULL) AS latest_growth,
  (SELECT avg(g) FROM (SELECT growth_pct AS g FROM gr b WHERE b.entity = gr.entity AND b.indicator = gr.indicator AND growth_pct IS NOT NULL
    ORDER BY year DESC LIMIT 3)) AS recent_avg_growth, avg(growth_pct) AS longrun_avg_growth FROM gr GROUP BY entity, indicator"""
SUMMARY_NUMBERS = ["earliest_value", "latest_value", "mean", "std", "peak_value", "trough_value", "pct_shift_halves", "overall_change_pct",
                   "latest_growth", "recent_avg_growth", "longrun_avg_growth", "momentum_gap"]
WINDOWS = "(VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in CRISIS_WINDOWS) + ") w(label, a, b)"
_P = CENTS.format("o_totalprice")

SQL = {
    "pillar_statistics": facts(describe("entity, indicator", '"value"', "fp"), "monthly", "quarterly", extra=FULL),
    "annual_statistics": facts(describe("entity, indicator, measure", "x", """(SELECT entity, indicator, 'value' AS measure, "value" AS x FROM gr
  UNION ALL SELECT entity, indicator, 'growth_pct', growth_pct FROM gr)"""), "monthly", "quarterly", extra=annual(GROWN)),
    "half_split_trends": facts("""SELECT entity, indicator, n, round(s, 2) AS pct_shift_halves, CASE WHEN n < 4 THEN 'insufficient_data' WHEN s > 5 THEN 'increasing'
  WHEN s < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT entity, indicator, count(*) AS n, coalesce(""" + SHIFT + """, 0) AS s FROM gr GROUP BY 1, 2)""",
    "monthly", "quarterly", extra=annual(GROWN)),
    "crisis_window_stats": facts(f"""SELECT entity, indicator, w.label AS period, count(*) AS n, round(avg("value"), 4) AS mean, round(min("value"), 4) AS min,
  round(max("value"), 4) AS max FROM ap JOIN {WINDOWS} ON year BETWEEN a AND b GROUP BY 1, 2, 3""", "monthly", "quarterly", extra=annual()),
    "inflation_regime_counts": facts("""SELECT entity, count(*) FILTER (hicp < 1) AS low, count(*) FILTER (hicp BETWEEN 1 AND 3) AS moderate,
  count(*) FILTER (hicp > 3) AS high FROM monthly GROUP BY 1"""),
    "peaks_and_troughs": facts("""SELECT entity, indicator, v1 AS peak, d1 AS peak_at, v2 AS trough, d2 AS trough_at FROM (
  SELECT entity, indicator, first("value" ORDER BY "value" DESC, period_start) AS v1, first(period_start ORDER BY "value" DESC, period_start) AS d1,
    first("value" ORDER BY "value", period_start) AS v2, first(period_start ORDER BY "value", period_start) AS d2
  FROM (UNPIVOT (SELECT entity, period_start, unemployment_rate, hicp, total_credit FROM monthly) ON unemployment_rate, hicp, total_credit
    INTO NAME indicator VALUE "value") GROUP BY 1, 2)"""),
    "pillar_summaries": facts(f"""SELECT entity, indicator, earliest_year, latest_year, peak_year, trough_year,
  CASE WHEN pct_shift_halves > 5 THEN 'increasing' WHEN pct_shift_halves < -5 THEN 'decreasing' ELSE 'stable' END AS trend,
  {", ".join(f"round({c}, 4) AS {c}" for c in SUMMARY_NUMBERS)} FROM (SELECT *, recent_avg_growth - longrun_avg_growth AS momentum_gap FROM ({SUMMARY}))""",
        "monthly", "quarterly", extra=annual(GROWN)),
    "crisis_impacts": facts(f"""SELECT entity, indicator, w.label, round(avg("value"), 4) AS mean_value, round(avg(growth_pct), 4) AS mean_growth,
  round(min("value"), 4) AS min_value, round(max("value"), 4) AS max_value FROM gr JOIN {WINDOWS} ON year BETWEEN a AND b GROUP BY 1, 2, 3""",
        "monthly", "quarterly", extra=annual(GROWN)),
    "latest_indicators": facts("""SELECT entity, indicator, max(period_start) AS latest_period, arg_max("value", period_start) AS latest, round(avg("value"), 4) AS mean,
  min("value") AS min, max("value") AS max, round(stddev_samp("value"), 4) AS std FROM fp GROUP BY 1, 2""", "monthly", "quarterly", extra=FULL),
    "latest_known": facts("""SELECT entity, indicator, max(period_start) AS period_start, arg_max("value", period_start) AS "value" FROM (UNPIVOT (
  SELECT entity, period_start, unemployment_rate, hicp, CASE WHEN year < 2001 THEN npl_ratio END AS npl_ratio FROM monthly)
  ON unemployment_rate, hicp, npl_ratio INTO NAME indicator VALUE "value") GROUP BY 1, 2"""),
    "annual_matrix": facts(f"""SELECT * FROM (SELECT entity, year, {", ".join(f"round(avg({c}), 4) AS {c}" for c in ("real_gdp", "debt_to_gdp_ratio", "gdp_growth_yoy"))}
  FROM quarterly GROUP BY 1, 2) JOIN (SELECT entity, year, {", ".join(f"round(avg({c}), 4) AS {c}" for c in PRIMARY if c not in ("real_gdp", "debt_to_gdp_ratio"))}
  FROM monthly GROUP BY 1, 2) USING (entity, year) WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*PRIMARY, "gdp_growth_yoy"])}""", "monthly", "quarterly"),
    "null_counts": facts(f"""SELECT entity, n_rows, round(({" + ".join(f"x{k}" for k in range(len(MONTHLY)))}) * 100.0 / (n_rows * {len(MONTHLY)}), 4) AS null_pct,
  unnest([{", ".join(f"'{c}'" for c in MONTHLY)}]) AS column_name, unnest([{", ".join(f"x{k}" for k in range(len(MONTHLY)))}]) AS n_null
FROM (SELECT entity, count(*) AS n_rows, {", ".join(f"count(*) FILTER ({c} IS NULL) AS x{k}" for k, c in enumerate(MONTHLY))} FROM monthly GROUP BY 1)"""),
    "duplicate_orders": "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "annualised_output": facts("""SELECT entity, count(*) AS quarters, round(sum(nominal_gdp), 2) AS annual_nominal_gdp FROM (SELECT * FROM quarterly
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_start DESC) <= 4) GROUP BY 1""", "quarterly"),
    "quarter_means": facts("""SELECT entity, q AS period_start, months, round(u, 4) AS mean_rate, round(u - lag(u) OVER (PARTITION BY entity ORDER BY q), 4) AS rate_change
FROM (SELECT entity, CAST(date_trunc('quarter', period_start) AS DATE) AS q, avg(unemployment_rate) AS u, count(*) AS months FROM monthly GROUP BY 1, 2)"""),
    "last_36_months": facts("""SELECT entity, period_start, total_credit FROM monthly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_start DESC) <= 36"""),
    "order_statistics": describe("o_orderpriority", "v", f"(SELECT o_orderpriority, CAST({_P} AS DOUBLE) AS v FROM orders)"),
}
