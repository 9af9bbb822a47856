"""DuckDB forms of the briefing tables."""

from __future__ import annotations

from indicatrix.oracle.base import facts
from indicatrix.oracle.statistics import annual
from indicatrix.oracle.summaries import GROWN, SUMMARY, WINDOWS
from indicatrix.plans.briefings import KEYWORDS, SECONDARY

TREND = "CASE WHEN pct_shift_halves > 5 THEN 'increasing' WHEN pct_shift_halves < -5 THEN 'decreasing' ELSE 'stable' END"
HEAD = f"""sm AS (SELECT *, {TREND} AS trend, recent_avg_growth - longrun_avg_growth AS momentum_gap FROM ({SUMMARY})),
hd AS (SELECT entity, indicator, trend, latest_value, momentum_gap, CASE WHEN overall_change_pct > 0 THEN 'expansion' ELSE 'contraction' END AS direction,
  CASE WHEN momentum_gap IS NULL THEN 'insufficient data' WHEN momentum_gap > 1 THEN 'above trend' WHEN momentum_gap < -1 THEN 'below trend' ELSE 'near trend' END AS momentum,
  CASE indicator WHEN 'real_gdp' THEN CASE WHEN latest_growth > 3 THEN 'robust expansion' WHEN latest_growth > 1 THEN 'moderate growth' WHEN latest_growth > 0 THEN 'fading growth' ELSE 'contraction' END
    WHEN 'unemployment_rate' THEN CASE WHEN latest_value < 7 THEN 'strong labour market' WHEN latest_value < 10 THEN 'moderate' WHEN latest_value < 14 THEN 'elevated' ELSE 'critical' END
    WHEN 'ecb_main_refinancing_rate' THEN CASE WHEN latest_value < 1 THEN 'ultra-low' WHEN latest_value < 3 THEN 'normalising' WHEN latest_value > 5 THEN 'elevated' ELSE 'tightening' END
    WHEN 'hicp' THEN CASE WHEN latest_value > 5 THEN 'surge' WHEN latest_value > 3 THEN 'above target' WHEN latest_value > 1.5 THEN 'near target' WHEN latest_value > 0 THEN 'low' ELSE 'deflation risk' END
    ELSE 'trend ' || trend END AS headline,
  CASE indicator WHEN 'real_gdp' THEN CASE WHEN coalesce(latest_growth, 0) < 0 THEN 'HIGH' WHEN recent_avg_growth < 1 THEN 'ELEVATED' WHEN recent_avg_growth > 3 THEN 'LOW' ELSE 'MODERATE' END
    WHEN 'total_credit' THEN CASE WHEN trend = 'decreasing' AND coalesce(recent_avg_growth, -1) < 0 THEN 'HIGH' WHEN trend = 'decreasing' THEN 'ELEVATED' ELSE 'MODERATE' END
    WHEN 'unemployment_rate' THEN CASE WHEN latest_value > 12 THEN 'HIGH' WHEN latest_value > 8 THEN 'ELEVATED' ELSE 'MODERATE' END
    WHEN 'ecb_main_refinancing_rate' THEN CASE WHEN latest_value > 4 THEN 'HIGH' WHEN latest_value > 2 THEN 'ELEVATED' ELSE 'MODERATE' END
    WHEN 'hicp' THEN CASE WHEN latest_value > 5 THEN 'HIGH' WHEN latest_value > 3 OR latest_value < 0.5 THEN 'ELEVATED' ELSE 'LOW-TO-MODERATE' END
    ELSE CASE WHEN latest_value > 120 THEN 'HIGH' WHEN latest_value > 90 THEN 'ELEVATED' ELSE 'MODERATE' END END AS risk_level FROM sm)"""


def of(indicator: str, c: str) -> str:
    return f"max({c}) FILTER (indicator = '{indicator}')"


WIDE = f"""(SELECT entity, {of('real_gdp', 'recent_avg_growth')} AS g, {of('unemployment_rate', 'trend')} AS ut, {of('ecb_main_refinancing_rate', 'trend')} AS rt,
  {of('total_credit', 'trend')} AS ct, {of('hicp', 'latest_value')} AS h, {of('ecb_main_refinancing_rate', 'latest_value')} AS r, {of('debt_to_gdp_ratio', 'trend')} AS dt FROM sm GROUP BY 1)"""
RANK = "CASE " + " ".join(f"WHEN contains(indicator, '{w}') THEN {i}" for i, (w, _) in enumerate(KEYWORDS)) + " END"
TOPIC = "CASE " + " ".join(f"WHEN contains(indicator, '{w}') THEN '{n}'" for w, n in KEYWORDS) + " END"


def latest(c: str) -> str:
    return f"arg_max({c}, period_start) FILTER ({c} IS NOT NULL) AS latest_{c}"


_E = annual(GROWN + ", " + HEAD)
SQL = {
    "briefing_headlines": facts("SELECT entity, indicator, headline, risk_level, direction, momentum, trend, round(latest_value, 4) AS latest_value, round(momentum_gap, 4) AS momentum_gap FROM hd",
                                "monthly", "quarterly", extra=_E),
    "briefing_crises": facts(f"""SELECT entity, indicator, label, round(mv, 4) AS mean_value, round(mg, 4) AS mean_growth, CASE WHEN indicator IN ('real_gdp', 'total_credit') THEN
  CASE WHEN mg < 0 THEN 'significant economic stress' WHEN mg > longrun_avg_growth + 0.5 THEN 'resilience' WHEN mg < longrun_avg_growth - 0.5 THEN 'significant stress' ELSE 'in line' END
  WHEN mv > mean + 1 THEN 'significant stress' WHEN mv < mean - 1 THEN 'resilience' ELSE 'in line' END AS impact
FROM (SELECT entity, indicator, w.label, avg("value") AS mv, avg(growth_pct) AS mg FROM gr JOIN {WINDOWS} ON year BETWEEN a AND b GROUP BY 1, 2, 3) JOIN sm USING (entity, indicator)""",
        "monthly", "quarterly", extra=_E),
    "briefing_secondary": facts(f"""SELECT * FROM (SELECT entity, indicator, {TOPIC} AS topic, CAST(row_number() OVER (PARTITION BY entity ORDER BY {RANK}, indicator) AS INTEGER) AS position,
  latest, mean, min, max FROM (SELECT entity, indicator, arg_max(v, period_start) AS latest, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max FROM (UNPIVOT (
  SELECT entity, period_start, {", ".join(SECONDARY)} FROM monthly) ON {", ".join(SECONDARY)} INTO NAME indicator VALUE v) GROUP BY 1, 2))"""),
    "briefing_relations": facts(f"""SELECT entity, 'growth_unemployment' AS relation, CASE WHEN g > 2 AND ut = 'decreasing' THEN 'strong' WHEN g > 0 AND ut <> 'decreasing' THEN 'weak'
  ELSE 'consistent_weakness' END AS relationship FROM w
UNION ALL SELECT entity, 'rates_credit', CASE WHEN rt = 'decreasing' AND ct = 'increasing' THEN 'strong' WHEN rt = 'decreasing' THEN 'impaired' WHEN rt = 'increasing' AND ct = 'decreasing'
  THEN 'strong' ELSE 'atypical' END FROM w
UNION ALL SELECT entity, 'inflation_policy', CASE WHEN h > 3 AND r > h THEN 'restrictive' WHEN h > 3 AND r < h THEN 'insufficiently restrictive' WHEN h < 1 AND r < 1 THEN 'disinflationary'
  ELSE 'neutral' END FROM w
UNION ALL SELECT entity, 'debt_growth', CASE WHEN g > 2 AND dt = 'decreasing' THEN 'favourable' WHEN g < 1 AND dt = 'increasing' THEN 'adverse' ELSE 'transitional' END FROM w""",
        "monthly", "quarterly", extra=_E + f", w AS {WIDE}"),
    "briefing_tone": facts("""SELECT entity, hi AS n_high, el AS n_elevated, CASE WHEN hi >= 2 THEN 'CONCERNING' WHEN hi >= 1 OR el >= 2 THEN 'CAUTIOUS' WHEN el >= 1 THEN 'BALANCED WITH CAVEATS'
  ELSE 'CAUTIOUSLY OPTIMISTIC' END AS tone FROM (SELECT entity, count(*) FILTER (risk_level = 'HIGH') AS hi, count(*) FILTER (risk_level = 'ELEVATED') AS el FROM hd GROUP BY 1)""",
        "monthly", "quarterly", extra=_E),
    "briefing_facts": facts(f"""SELECT * FROM (SELECT entity, {latest('debt_to_gdp_ratio')}, {latest('budget_deficit')}, max(debt_to_gdp_ratio) AS peak_debt_to_gdp_ratio FROM quarterly GROUP BY 1)
JOIN (SELECT entity, {latest('unemployment_rate')}, {latest('npl_ratio')}, {latest('hicp')}, max(unemployment_rate) AS peak_unemployment_rate FROM monthly GROUP BY 1) USING (entity)""",
        "monthly", "quarterly"),
}
