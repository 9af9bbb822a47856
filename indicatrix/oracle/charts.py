"""DuckDB forms of the chart tables."""

from __future__ import annotations

from indicatrix.oracle.base import facts
from indicatrix.oracle.cleaning import lerp
from indicatrix.plans.charts import MATRIX, TIMELINE
from indicatrix.plans.economy import CRISIS_WINDOWS
from indicatrix.registry import PILLARS

B, Y = "ecb_main_refinancing_rate", "portugal_10y_bond_yield"
QUARTERLY = [c for p in PILLARS.values() if p.grain == "quarter" for c in p.columns]
_M, _Q = [c for c in MATRIX if c not in QUARTERLY], [c for c in MATRIX if c in QUARTERLY]
QM = f"""qm AS (SELECT * FROM (SELECT entity, period_start, {", ".join(_Q)} FROM quarterly) FULL JOIN (SELECT entity, CAST(date_trunc('quarter', period_start) AS DATE) AS period_start,
  {", ".join(f"avg({c}) AS {c}" for c in _M)} FROM monthly GROUP BY 1, 2) USING (entity, period_start))"""
PAIRS = " UNION ALL ".join(f"""SELECT entity, '{a}' AS a, '{b}' AS b, CAST(regr_count({b}, {a}) AS BIGINT) AS n, round(CASE WHEN regr_count({b}, {a}) >= 3 THEN corr({b}, {a}) END, 4) AS r
FROM qm GROUP BY 1""" for i, a in enumerate(MATRIX) for b in MATRIX[i + 1:])


def scale(c: str, alias: str) -> str:
    return f"""round(CASE WHEN max({c}) OVER e = min({c}) OVER e AND {c} IS NOT NULL THEN 50 ELSE ({c} - min({c}) OVER e) / NULLIF(max({c}) OVER e - min({c}) OVER e, 0) * 100 END, 2) AS {alias}"""


SQL = {
    "chart_annual_output": facts("SELECT entity, year, round(sum(nominal_gdp), 2) AS annual_gdp, round(avg(gdp_growth_yoy), 4) AS mean_growth FROM quarterly GROUP BY 1, 2", "quarterly"),
    "chart_unemployment": facts("""SELECT entity, period_start, unemployment_rate, youth_unemployment_rate, long_term_unemployment_rate, round(CASE WHEN count(unemployment_rate) OVER w >= 6
  THEN avg(unemployment_rate) OVER w END, 4) AS ma12 FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY period_start ROWS 11 PRECEDING)"""),
    "chart_credit": facts("SELECT entity, period_start, credit_nfc, credit_households, npl_ratio FROM monthly"),
    "chart_rates": facts(f"SELECT entity, period_start, {B}, euribor_3m, euribor_6m, euribor_12m, {Y} FROM monthly"),
    "chart_inflation": facts("""SELECT entity, period_start, hicp, core_inflation, round(avg(hicp) OVER (PARTITION BY entity, year), 4) AS annual_mean,
  CASE WHEN hicp < 0 THEN 'negative' WHEN hicp < 1 THEN 'below' WHEN hicp <= 3 THEN 'near target' WHEN hicp > 3 THEN 'above' END AS position FROM monthly"""),
    "chart_debt": facts("SELECT entity, period_start, debt_to_gdp_ratio, budget_deficit, total_debt FROM quarterly", "quarterly"),
    "chart_correlations": facts(PAIRS, "monthly", "quarterly", extra=QM),
    "chart_panels": facts(f"""SELECT entity, indicator, latest_at, round(latest, 4) AS latest, round(latest - before, 4) AS change FROM (SELECT entity, indicator, max(period_start) AS latest_at,
  max(v) FILTER (k = 1) AS latest, coalesce(max(v) FILTER (k = 13), arg_min(v, period_start)) AS before FROM (SELECT *, row_number() OVER (PARTITION BY entity, indicator ORDER BY period_start DESC) AS k
  FROM (SELECT * FROM (UNPIVOT (SELECT entity, period_start, unemployment_rate, total_credit, portugal_10y_bond_yield, hicp FROM monthly)
    ON unemployment_rate, total_credit, portugal_10y_bond_yield, hicp INTO NAME indicator VALUE v) UNION ALL
  SELECT * FROM (UNPIVOT (SELECT entity, period_start, nominal_gdp, debt_to_gdp_ratio FROM quarterly) ON nominal_gdp, debt_to_gdp_ratio INTO NAME indicator VALUE v))) GROUP BY 1, 2)""",
        "monthly", "quarterly"),
    "chart_phillips_means": facts("""SELECT entity, year, count(*) AS n, round(avg(unemployment_rate), 4) AS x, round(avg(hicp), 4) AS y FROM monthly
WHERE unemployment_rate IS NOT NULL AND hicp IS NOT NULL GROUP BY 1, 2"""),
    "chart_timeline": facts(f"SELECT entity, period_start, {', '.join(scale(c, c) for c in TIMELINE)} FROM monthly WINDOW e AS (PARTITION BY entity)"),
    "chart_growth_monthly": facts(f"""SELECT entity, period_start, round(v, 4) AS growth, {scale('v', 'scaled')} FROM (SELECT entity, period_start, {lerp('x')} AS v FROM (
  SELECT g.entity, g.p AS period_start, q.gdp_growth_yoy AS x, row_number() OVER (PARTITION BY g.entity ORDER BY g.p) AS i FROM (SELECT entity,
    CAST(unnest(generate_series(min(period_start), max(period_start), INTERVAL 1 MONTH)) AS DATE) AS p FROM quarterly WHERE gdp_growth_yoy IS NOT NULL GROUP BY 1) g
  LEFT JOIN quarterly q ON q.entity = g.entity AND q.period_start = g.p)) WINDOW e AS (PARTITION BY entity)""", "quarterly"),
    "chart_shading": facts(f"""SELECT entity, period, greatest(make_date(a, 1, 1), f) AS shade_from, least(make_date(b, 12, 31), l) AS shade_to FROM (
  SELECT entity, min(period_start) AS f, max(period_start) AS l FROM monthly GROUP BY 1) JOIN (VALUES {", ".join(f"('{n}', {a}, {b})" for n, a, b in CRISIS_WINDOWS)}) p(period, a, b)
  ON make_date(a, 1, 1) <= l AND make_date(b, 12, 31) >= f"""),
}
