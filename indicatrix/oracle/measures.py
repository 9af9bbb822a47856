"""DuckDB forms of the report measures."""

from __future__ import annotations

from indicatrix.oracle.base import facts, period_case
from indicatrix.plans.measures import AVERAGES, LATEST, YOY
from indicatrix.registry import PILLARS

QUARTERLY = {c for p in PILLARS.values() if p.grain == "quarter" for c in p.columns}
B, Y = "ecb_main_refinancing_rate", "portugal_10y_bond_yield"


def latest(columns: list[str]) -> str:
    def one(source: str, names: list[str]) -> str:
        return f"(SELECT entity, {', '.join(f'arg_max({c}, period_start) FILTER ({c} IS NOT NULL) AS {c}' for c in names)} FROM {source} GROUP BY 1)"
    return f"{one('quarterly', [c for c in columns if c in QUARTERLY])} q JOIN {one('monthly', [c for c in columns if c not in QUARTERLY])} m USING (entity)"


def yoy(name: str, c: str, kind: str) -> str:
    source = "quarterly" if c in QUARTERLY else "monthly"
    value = f"a.{c} - b.{c}" if kind == "pp" else f"(a.{c} - b.{c}) / NULLIF(b.{c}, 0)"
    return f"""SELECT a.entity, a.date_key, '{name}' AS measure, round({value}, 6) AS "value" FROM {source} a JOIN {source} b ON a.entity = b.entity
  AND b.period_start = a.period_start - INTERVAL 1 YEAR WHERE {value} IS NOT NULL"""


def average(name: str, c: str, k: int) -> str:
    return f"round(avg({c}) OVER (PARTITION BY entity ORDER BY period_start RANGE BETWEEN INTERVAL {k - 1} MONTH PRECEDING AND CURRENT ROW), 4) AS {name}"


def arrow(c: str, limit: float) -> str:
    return f"CASE WHEN {c} > {limit}::DOUBLE THEN '▲' WHEN {c} < -{limit}::DOUBLE THEN '▼' ELSE '►' END"


FF = "last_value({0} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period_start ROWS UNBOUNDED PRECEDING)"
PERIOD = period_case("year")
NEWEST = """nq AS (SELECT a.entity, a.gdp_growth_yoy - b.gdp_growth_yoy AS g, a.debt_to_gdp_ratio - b.debt_to_gdp_ratio AS d
  FROM (SELECT * FROM quarterly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_start DESC) = 1) a
  LEFT JOIN quarterly b ON a.entity = b.entity AND b.period_start = a.period_start - INTERVAL 1 YEAR),
nm AS (SELECT a.entity, a.hicp AS h, a.unemployment_rate - b.unemployment_rate AS u, a.hicp - b.hicp AS hm, (a.total_credit - b.total_credit) / NULLIF(b.total_credit, 0) AS c,
  a.ecb_main_refinancing_rate - b.ecb_main_refinancing_rate AS e FROM (SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_start DESC) = 1) a
  LEFT JOIN monthly b ON a.entity = b.entity AND b.period_start = a.period_start - INTERVAL 1 YEAR)"""

SQL = {
    "kpi_latest": facts(f"SELECT entity, {', '.join(f'round({c} / {d}.0::DOUBLE, 6) AS {n}' for n, c, d in LATEST)} FROM {latest([c for _, c, _ in LATEST])}", "monthly", "quarterly"),
    "kpi_yoy": facts(" UNION ALL ".join(yoy(*x) for x in YOY), "monthly", "quarterly"),
    "kpi_moving_averages": facts(f"SELECT entity, date_key, {', '.join(average(*x) for x in AVERAGES)} FROM monthly"),
    "kpi_derived": facts(f"""SELECT entity, date_key, round(({Y} - {B}) * 100, 2) AS sovereign_spread_bps, round(({FF.format(B)} - {FF.format('hicp')}) / 100, 6) AS real_interest_rate,
  round(youth_unemployment_rate - unemployment_rate, 2) AS youth_unemployment_gap FROM monthly"""),
    "kpi_credit_to_gdp": facts("""SELECT q.entity, q.date_key, round(c / NULLIF(nominal_gdp * 4, 0), 6) AS credit_to_gdp_ratio, round(gdp_per_capita, 2) AS avg_gdp_per_capita
FROM quarterly q LEFT JOIN (SELECT entity, date_trunc('quarter', period_start) AS p, avg(total_credit) AS c FROM monthly GROUP BY 1, 2) m
  ON m.entity = q.entity AND m.p = q.period_start WHERE nominal_gdp IS NOT NULL""", "monthly", "quarterly"),
    "kpi_by_period": facts(f"""SELECT * FROM (SELECT entity, {PERIOD} AS economic_period, round(avg(unemployment_rate), 4) AS avg_unemployment FROM monthly GROUP BY 1, 2)
JOIN (SELECT entity, {PERIOD} AS economic_period, round(avg(gdp_growth_yoy) / 100, 6) AS period_gdp_growth, round(avg(budget_deficit) / 100, 6) AS avg_budget_balance
  FROM quarterly GROUP BY 1, 2) USING (entity, economic_period)""", "monthly", "quarterly"),
    "trend_arrows": facts(f"""SELECT entity, {arrow('g', 0.5)} AS gdp_growth, {arrow('u', 0.3)} AS unemployment, CASE WHEN h IS NULL OR abs(h - 2) <= 0.5 THEN '►' WHEN h > 2 AND hm < 0 THEN '▼'
  WHEN h < 2 AND hm > 0 THEN '▲' WHEN hm > 0 THEN '▲' ELSE '▼' END AS inflation, {arrow('c', 0.01)} AS credit, {arrow('e', 0.1)} AS ecb_rate, {arrow('d', 1.0)} AS debt
FROM nq JOIN nm USING (entity)""", "monthly", "quarterly", extra=NEWEST),
    "traffic_lights": facts(f"""SELECT entity, CASE WHEN gdp_growth_yoy > 2 THEN 'Green' WHEN gdp_growth_yoy >= 0 THEN 'Amber' ELSE 'Red' END AS gdp_growth,
  CASE WHEN unemployment_rate < 7 THEN 'Green' WHEN unemployment_rate <= 10 THEN 'Amber' ELSE 'Red' END AS unemployment,
  CASE WHEN hicp < 0 OR hicp > 5 OR hicp IS NULL THEN 'Red' WHEN hicp < 1 OR hicp > 3 THEN 'Amber' ELSE 'Green' END AS inflation,
  CASE WHEN debt_to_gdp_ratio < 60 THEN 'Green' WHEN debt_to_gdp_ratio <= 100 THEN 'Amber' ELSE 'Red' END AS debt_to_gdp,
  CASE WHEN npl_ratio < 3 THEN 'Green' WHEN npl_ratio <= 5 THEN 'Amber' ELSE 'Red' END AS npl_ratio,
  CASE WHEN ({Y} - {B}) * 100 < 100 THEN 'Green' WHEN ({Y} - {B}) * 100 <= 300 THEN 'Amber' ELSE 'Red' END AS sovereign_spread
FROM {latest(['gdp_growth_yoy', 'debt_to_gdp_ratio', 'unemployment_rate', 'hicp', 'npl_ratio', Y, B])}""", "monthly", "quarterly"),
    "calendar_columns": facts(f"""SELECT grain, date_key, n_entities, {PERIOD} AS economic_period, CAST(substr({PERIOD}, 1, 1) AS INTEGER) AS period_sort_order,
  year || ' Q' || q AS year_quarter, CASE WHEN grain = 'month' THEN date_key END AS year_month FROM (
  SELECT 'month' AS grain, date_key, count(*) AS n_entities, year, quarter(period_start) AS q FROM monthly GROUP BY ALL
  UNION ALL SELECT 'quarter', date_key, count(*), year, quarter FROM quarterly GROUP BY ALL)""", "monthly", "quarterly"),
}
