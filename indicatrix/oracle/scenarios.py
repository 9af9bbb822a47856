"""DuckDB forms of the scenarios."""

from __future__ import annotations

from indicatrix.operators.scenario import LATEST_MONTHLY, LATEST_QUARTERLY
from indicatrix.oracle.base import facts

B, Y = "ecb_main_refinancing_rate", "portugal_10y_bond_yield"


def _latest(columns: list[str]) -> str:
    return ", ".join(f"arg_max({c}, period_start) FILTER ({c} IS NOT NULL) AS {c}" for c in columns)


EXTRA = f"""bl AS (SELECT * FROM (SELECT entity, {_latest(LATEST_QUARTERLY)}, sum(nominal_gdp) FILTER (k <= 4) AS annual_gdp
  FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_start DESC) AS k FROM quarterly) GROUP BY 1)
  JOIN (SELECT entity, {_latest(LATEST_MONTHLY)} FROM monthly GROUP BY 1) USING (entity)),
ok AS (SELECT entity, regr_slope(du, g) AS s, regr_count(du, g) AS n FROM (SELECT m.entity, u - lag(u) OVER (PARTITION BY m.entity ORDER BY m.p) AS du, q.gdp_growth_yoy AS g
  FROM (SELECT entity, CAST(date_trunc('quarter', period_start) AS DATE) AS p, avg(unemployment_rate) AS u FROM monthly GROUP BY 1, 2) m
  JOIN quarterly q ON q.entity = m.entity AND q.period_start = m.p) GROUP BY 1),
cr AS (SELECT entity, regr_slope(dc, dr) AS s, regr_count(dc, dr) AS n FROM (SELECT entity, (ln(total_credit) - ln(lag(total_credit) OVER w)) * 100 AS dc,
  euribor_12m - lag(euribor_12m) OVER w AS dr FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY period_start)) GROUP BY 1),
co AS (SELECT entity, CASE WHEN ok.n >= 10 THEN ok.s ELSE -0.4 END AS okun, CASE WHEN ok.n >= 10 THEN 'data-driven' ELSE 'textbook' END AS okun_source,
  CASE WHEN cr.n >= 20 THEN cr.s ELSE -3.0 END AS credit_elasticity, CASE WHEN cr.n >= 20 THEN 'data-driven' ELSE 'textbook' END AS credit_source
  FROM ok JOIN cr USING (entity))"""


def shocks(*sizes: float) -> str:
    return "(SELECT *, shock / 100 AS d FROM bl JOIN co USING (entity) CROSS JOIN (VALUES " + ", ".join(f"({s}::DOUBLE)" for s in sizes) + ") v(shock))"


DEBT = "debt_to_gdp_ratio * pow(a, y) - shock * CASE WHEN abs(a - 1) < 1e-12 THEN y ELSE (pow(a, y) - 1) / (a - 1) END"

SQL = {name: facts(sql, "monthly", "quarterly", extra=EXTRA) for name, sql in {
    "scenario_baseline": "SELECT * REPLACE (round(annual_gdp, 2) AS annual_gdp) FROM bl",
    "scenario_coefficients": "SELECT entity, round(okun, 4) AS okun, okun_source, round(credit_elasticity, 4) AS credit_elasticity, credit_source FROM co",
    "scenario_rate_shock": f"""SELECT entity, shock, round({B}, 3) AS ecb_rate_base, round({B} + d, 3) AS ecb_rate_stressed, round(euribor_12m + d, 3) AS euribor_12m_stressed,
  round({Y} + d + shock * 0.4 / 100, 3) AS bond_yield_stressed, round(total_debt * d / 100, 1) AS additional_debt_servicing,
  round(total_debt * d / 100 / annual_gdp * 100, 2) AS debt_servicing_gdp_pct, round(120000 * d / 100 / 12, 0) AS mortgage_monthly_increase,
  round(credit_elasticity * d, 2) AS credit_growth_change_pct, round(shock * 0.4, 0) AS spread_widening_bps FROM {shocks(100, 200)}""",
    "scenario_output_shock": f"""SELECT entity, shock, round(gdp_growth_yoy + shock, 2) AS gdp_growth_stressed, round(unemployment_rate, 2) AS unemployment_base,
  round(unemployment_rate + okun * shock, 2) AS unemployment_stressed, round(okun * shock, 2) AS unemployment_change_pp,
  round(total_debt / (annual_gdp * (1 + d)) * 100, 2) AS debt_ratio_stressed, round(total_debt / (annual_gdp * (1 + d)) * 100 - debt_to_gdp_ratio, 2) AS debt_ratio_change_pp,
  round(greatest(npl_ratio - 2.5 * shock, 0), 2) AS npl_ratio_stressed, round(1.1 * shock, 2) AS tax_revenue_change_pct,
  round(abs(annual_gdp * 0.42 * 1.1 * d), 1) AS tax_revenue_loss FROM {shocks(-2, -4)}""",
    "scenario_inflation_shock": f"""SELECT entity, shock, round(shock - hicp, 2) AS inflation_increase_pp, round({Y} - hicp, 2) AS real_yield_base, round({Y} - shock, 2) AS real_yield_stressed,
  round(((1 + hicp / 100) / (1 + d) - 1) * 100, 2) AS purchasing_power_change_pct, round(annual_gdp * (1 + (shock - hicp) / 100), 1) AS nominal_gdp_stressed,
  round(total_debt / (annual_gdp * (1 + (shock - hicp) / 100)) * 100, 2) AS debt_ratio_stressed,
  round(total_debt / (annual_gdp * (1 + (shock - hicp) / 100)) * 100 - debt_to_gdp_ratio, 2) AS debt_ratio_change_pp,
  round(1100 * (shock - hicp) / 100, 0) AS household_cost_increase FROM {shocks(4, 6)}""",
    "scenario_consolidation": f"""SELECT entity, shock, round(budget_deficit, 2) AS balance_base, round(abs(shock - budget_deficit), 2) AS adjustment_pp,
  round(abs(shock - budget_deficit) / 100 * annual_gdp, 1) AS adjustment_amount, CASE WHEN shock > budget_deficit THEN 'tightening' ELSE 'loosening' END AS direction,
  round(-0.7 * (shock - budget_deficit), 2) AS gdp_impact_pct, round(abs(0.7 * (shock - budget_deficit)) / 100 * annual_gdp, 1) AS gdp_impact_amount,
  CASE WHEN debt_to_gdp_ratio <= 60 THEN 0 ELSE list_min(list_filter(range(1, 101), lambda y: {DEBT} <= 60))::INTEGER END AS years_to_target
FROM (SELECT *, (1 + {Y} / 100) / 1.02 AS a FROM {shocks(-1, 8)})""",
    "scenario_combined": """SELECT entity, round(unemployment_rate - 2 * okun, 2) AS worst_unemployment_pct, round(total_debt / (annual_gdp * 0.98) * 100, 2) AS worst_debt_to_gdp_pct,
  round(total_debt * 2 / 100, 1) AS worst_additional_debt_cost, CASE WHEN debt_to_gdp_ratio > 90 THEN 'HIGH' ELSE 'MODERATE' END AS debt_risk,
  CASE WHEN unemployment_rate < 7 THEN 'LOW' ELSE 'MODERATE' END AS labour_risk, CASE WHEN hicp < 3 THEN 'LOW' ELSE 'ELEVATED' END AS price_risk FROM bl JOIN co USING (entity)""",
}.items()}


def part(name: str, query: str, shock: int) -> str:
    return f"(SELECT COLUMNS('(.*)') AS '{name}_\\1' FROM (SELECT * EXCLUDE (shock) FROM ({SQL[query]}) WHERE shock = {shock})) {name}"


_PARTS = [("rate", "scenario_rate_shock", 200), ("output", "scenario_output_shock", -2), ("inflation", "scenario_inflation_shock", 6), ("consolidation", "scenario_consolidation", -1)]
SQL["scenario_report"] = f"SELECT * EXCLUDE ({', '.join(f'{n}_entity' for n, _, _ in _PARTS)}) FROM ({SQL['scenario_combined']}) c " + " ".join(
    f"LEFT JOIN {part(*p)} ON {p[0]}_entity = c.entity" for p in _PARTS)
