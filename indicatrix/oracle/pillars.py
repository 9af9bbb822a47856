"""DuckDB forms of the 36 pillar queries."""

from __future__ import annotations

from indicatrix.oracle.base import facts, period_case

MA12 = "OVER (PARTITION BY entity ORDER BY period_start ROWS 11 PRECEDING)"
W = "OVER (PARTITION BY entity ORDER BY period_start)"
B = "ecb_main_refinancing_rate"
Y = "portugal_10y_bond_yield"
MKEYS = "entity, year, month, date_key"
QKEYS = "entity, year, quarter, date_key"
ANNUAL = """annual AS (SELECT entity, year, sum(nominal_gdp) AS nominal, sum(real_gdp) AS real_, avg(gdp_per_capita) AS pc,
  count(*) AS n FROM quarterly GROUP BY 1, 2)"""
PERIOD = period_case("year")


def scored(name: str, measure: str, invert: bool) -> str:
    part = f"({measure} - min({measure}) OVER e) / NULLIF(max({measure}) OVER e - min({measure}) OVER e, 0)"
    return f"{'(1.0::DOUBLE - ' + part + ')' if invert else '(' + part + ')'} AS {name}"


SCORES = [("s1", "g", False), ("s2", "u", True), ("s3", "i", True), ("s4", "n", True), ("s5", "d", True), ("s6", "p", True)]

SQL: dict[str, str] = {
    "gdp_annual_summary": facts("""
SELECT a.entity, a.year, a.n AS quarters_reported, round(a.nominal, 2) AS annual_nominal_gdp_eur_m,
  round(a.real_, 2) AS annual_real_gdp_eur_m, round(a.pc, 2) AS avg_gdp_per_capita_eur,
  round((a.real_ - b.real_) / NULLIF(b.real_, 0) * 100.0::DOUBLE, 2) AS real_gdp_yoy_growth_pct
FROM annual a LEFT JOIN annual b ON a.entity = b.entity AND b.year = a.year - 1""", "quarterly", extra=ANNUAL),
    "gdp_growth_ranking": facts("""
SELECT entity, CAST(rank() OVER (PARTITION BY entity ORDER BY g DESC) AS INTEGER) AS growth_rank, year,
  g AS real_gdp_growth_pct,
  CASE WHEN g > 3 THEN 'Strong expansion' WHEN g > 0 THEN 'Moderate growth' WHEN g > -1 THEN 'Stagnation'
    ELSE 'Contraction' END AS classification
FROM (SELECT a.entity, a.year, round((a.real_ - b.real_) / NULLIF(b.real_, 0) * 100.0::DOUBLE, 2) AS g
  FROM annual a JOIN annual b ON a.entity = b.entity AND b.year = a.year - 1)""", "quarterly", extra=ANNUAL),
    "gdp_period_comparison": facts(f"""
SELECT entity, {PERIOD} AS economic_period, count(*) AS quarter_count, round(avg(nominal_gdp), 2) AS avg_nominal_gdp_eur_m,
  round(avg(real_gdp), 2) AS avg_real_gdp_eur_m, round(avg(gdp_growth_yoy), 2) AS avg_yoy_growth_pct,
  round(avg(gdp_per_capita), 2) AS avg_gdp_per_capita_eur, round(min(gdp_growth_yoy), 2) AS worst_quarter_growth_pct,
  round(max(gdp_growth_yoy), 2) AS best_quarter_growth_pct FROM quarterly GROUP BY 1, 2""", "quarterly"),
    "gdp_quarter_seasonality": facts("""
SELECT entity, quarter, 'Q' || quarter AS quarter_label, count(*) AS observations,
  round(avg(nominal_gdp), 2) AS avg_nominal_gdp_eur_m, round(avg(real_gdp), 2) AS avg_real_gdp_eur_m,
  round(avg(gdp_growth_qoq), 2) AS avg_qoq_growth_pct, round(avg(gdp_growth_yoy), 2) AS avg_yoy_growth_pct,
  round(min(gdp_growth_qoq), 2) AS min_qoq_growth_pct, round(max(gdp_growth_qoq), 2) AS max_qoq_growth_pct
FROM quarterly GROUP BY 1, 2""", "quarterly"),
    "gdp_per_capita_evolution": facts("""
SELECT a.entity, a.year, round(a.pc, 2) AS gdp_per_capita_eur,
  round((a.pc - b.pc) / NULLIF(b.pc, 0) * 100.0::DOUBLE, 2) AS yoy_change_pct,
  round((a.pc - z.base) / NULLIF(z.base, 0) * 100.0::DOUBLE, 2) AS cumulative_growth_from_base_pct
FROM annual a LEFT JOIN annual b ON a.entity = b.entity AND b.year = a.year - 1
JOIN (SELECT entity, arg_min(pc, year) AS base FROM annual GROUP BY 1) z ON z.entity = a.entity""",
        "quarterly", extra=ANNUAL),
    "unemp_trend_ma12": facts(f"""
SELECT {MKEYS}, unemployment_rate, round(avg(unemployment_rate) {MA12}, 2) AS unemployment_rate_12m_ma,
  round(unemployment_rate - avg(unemployment_rate) {MA12}, 2) AS deviation_from_ma FROM monthly"""),
    "unemp_youth_gap": facts(f"""
SELECT {MKEYS}, unemployment_rate, youth_unemployment_rate,
  round(youth_unemployment_rate - unemployment_rate, 2) AS absolute_gap_pp,
  round(CASE WHEN unemployment_rate > 0 THEN youth_unemployment_rate / unemployment_rate END, 2) AS youth_to_general_ratio,
  round(avg(CASE WHEN unemployment_rate > 0 THEN youth_unemployment_rate / unemployment_rate END) {MA12}, 2) AS ratio_12m_ma
FROM monthly WHERE unemployment_rate IS NOT NULL AND youth_unemployment_rate IS NOT NULL"""),
    "unemp_annual_stats": facts("""
SELECT entity, year, count(*) AS months_reported, round(avg(unemployment_rate), 2) AS avg_unemployment_pct,
  round(min(unemployment_rate), 2) AS min_unemployment_pct, round(max(unemployment_rate), 2) AS max_unemployment_pct,
  round(max(unemployment_rate) - min(unemployment_rate), 2) AS intra_year_range_pp,
  round(stddev_pop(unemployment_rate), 2) AS stddev_unemployment,
  round(avg(youth_unemployment_rate), 2) AS avg_youth_unemployment_pct,
  round(avg(long_term_unemployment_rate), 2) AS avg_long_term_unemployment_pct FROM monthly GROUP BY 1, 2"""),
    "unemp_period_impact": facts(f"""
SELECT entity, {PERIOD} AS economic_period, count(*) AS month_count, round(avg(unemployment_rate), 2) AS avg_unemployment_pct,
  round(max(unemployment_rate), 2) AS peak_unemployment_pct,
  round(avg(youth_unemployment_rate), 2) AS avg_youth_unemployment_pct,
  round(avg(long_term_unemployment_rate), 2) AS avg_long_term_unemployment_pct,
  round(avg(labour_force_participation_rate), 2) AS avg_participation_rate_pct FROM monthly GROUP BY 1, 2"""),
    "labour_health_index": facts(f"""
SELECT *, round(0.60::DOUBLE * unemployment_score + 0.40::DOUBLE * participation_score, 2) AS labour_market_health_index FROM (
  SELECT {MKEYS}, unemployment_rate, labour_force_participation_rate,
    round((1.0::DOUBLE - (unemployment_rate - ul) / NULLIF(uh - ul, 0)) * 100.0::DOUBLE, 2) AS unemployment_score,
    round((labour_force_participation_rate - pl) / NULLIF(ph - pl, 0) * 100.0::DOUBLE, 2) AS participation_score
  FROM monthly JOIN (SELECT entity, min(unemployment_rate) AS ul, max(unemployment_rate) AS uh,
    min(labour_force_participation_rate) AS pl, max(labour_force_participation_rate) AS ph FROM monthly GROUP BY 1)
    USING (entity))"""),
    "credit_evolution": facts(f"""
SELECT {MKEYS}, round(total_credit, 2) AS total_credit_eur_m, round(credit_nfc, 2) AS credit_nfc_eur_m,
  round(credit_households, 2) AS credit_households_eur_m,
  round((total_credit - lag(total_credit, 12) {W}) / NULLIF(lag(total_credit, 12) {W}, 0) * 100.0::DOUBLE, 2)
    AS total_credit_yoy_growth_pct FROM monthly"""),
    "credit_composition": facts(f"""
SELECT {MKEYS}, round(total_credit, 2) AS total_credit_eur_m, round(credit_nfc, 2) AS credit_nfc_eur_m,
  round(credit_households, 2) AS credit_households_eur_m,
  round(credit_nfc / NULLIF(total_credit, 0) * 100.0::DOUBLE, 2) AS nfc_share_pct,
  round(credit_households / NULLIF(total_credit, 0) * 100.0::DOUBLE, 2) AS household_share_pct,
  round((total_credit - credit_nfc - credit_households) / NULLIF(total_credit, 0) * 100.0::DOUBLE, 2) AS other_share_pct
FROM monthly"""),
    "npl_trend": facts(f"""
SELECT {MKEYS}, round(npl_ratio, 2) AS npl_ratio_pct, round(avg(npl_ratio) {MA12}, 2) AS npl_ratio_12m_ma,
  CASE WHEN npl_ratio < 3 THEN 'Healthy' WHEN npl_ratio < 7 THEN 'Warning' ELSE 'Critical' END AS npl_classification,
  lag(npl_ratio, 12) {W} AS npl_ratio_12m_ago, round(npl_ratio - lag(npl_ratio, 12) {W}, 2) AS npl_change_yoy_pp
FROM monthly WHERE npl_ratio IS NOT NULL"""),
    "credit_to_gdp": facts("""
SELECT m.entity, m.year, q.quarter, 'Q' || q.quarter AS quarter_label, round(total_credit, 2) AS total_credit_eur_m,
  round(nominal_gdp, 2) AS nominal_gdp_eur_m,
  round(total_credit / NULLIF(nominal_gdp, 0) * 100.0::DOUBLE, 2) AS credit_to_gdp_ratio_pct
FROM monthly m JOIN quarterly q ON m.entity = q.entity AND m.period_start = q.period_start + INTERVAL 2 MONTH""",
        "monthly", "quarterly"),
    "deleveraging_episodes": facts(f"""
SELECT entity, min(date_key) AS episode_start, max(date_key) AS episode_end, count(*) AS consecutive_months,
  round(sum(move), 2) AS total_credit_change_eur_m,
  round(sum(move) / NULLIF(max(total_credit), 0) * 100.0::DOUBLE, 2) AS pct_change_over_episode
FROM (SELECT *, row_number() {W} - row_number() OVER (PARTITION BY entity, down ORDER BY period_start) AS g
  FROM (SELECT *, move < 0 AS down FROM (SELECT *, total_credit - lag(total_credit) {W} AS move,
      lag(total_credit) {W} AS before FROM monthly) WHERE before IS NOT NULL))
WHERE down GROUP BY entity, g HAVING count(*) >= 3"""),
    "rate_environment": facts(f"""
SELECT {MKEYS}, {B}, CASE WHEN {B} <= 0 THEN 'Zero / Negative' WHEN {B} <= 1 THEN 'Low' WHEN {B} <= 2.5 THEN 'Medium'
  WHEN {B} <= 4 THEN 'High' ELSE 'Very high' END AS rate_environment, round(avg({B}) {MA12}, 3) AS ecb_rate_12m_ma
FROM monthly WHERE {B} IS NOT NULL"""),
    "yield_spread": facts(f"""
SELECT {MKEYS}, {Y}, {B}, round({Y} - {B}, 3) AS sovereign_spread_pp,
  CASE WHEN {Y} - {B} > 5 THEN 'Extreme stress' WHEN {Y} - {B} > 3 THEN 'High stress' WHEN {Y} - {B} > 1.5 THEN 'Elevated'
    ELSE 'Normal' END AS stress_level, round(avg({Y} - {B}) {MA12}, 3) AS spread_12m_ma
FROM monthly WHERE {Y} IS NOT NULL AND {B} IS NOT NULL"""),
    "euribor_term_structure": facts(f"""
SELECT {MKEYS}, euribor_3m, euribor_6m, euribor_12m, round(euribor_6m - euribor_3m, 3) AS spread_6m_3m_pp,
  round(euribor_12m - euribor_3m, 3) AS spread_12m_3m_pp, round(euribor_12m - euribor_6m, 3) AS spread_12m_6m_pp,
  CASE WHEN euribor_12m > euribor_6m AND euribor_6m > euribor_3m THEN 'Normal (upward)'
    WHEN euribor_12m < euribor_6m AND euribor_6m < euribor_3m THEN 'Inverted' ELSE 'Flat / Mixed' END AS curve_shape
FROM monthly WHERE euribor_3m IS NOT NULL AND euribor_6m IS NOT NULL AND euribor_12m IS NOT NULL"""),
    "rate_momentum": facts(f"""
SELECT {MKEYS}, {B}, round(mom, 3) AS mom_change_pp, round(yoy, 3) AS yoy_change_pp,
  CASE WHEN mom > 0 THEN 'Tightening' WHEN mom < 0 THEN 'Easing' ELSE 'Unchanged' END AS policy_direction,
  round(sum(mom) OVER (PARTITION BY entity ORDER BY period_start ROWS 5 PRECEDING), 3) AS cumulative_6m_change_pp
FROM (SELECT *, {B} - lag({B}) {W} AS mom, {B} - lag({B}, 12) {W} AS yoy FROM monthly WHERE {B} IS NOT NULL)
WHERE mom IS NOT NULL"""),
    "crisis_premium": facts(f"""
SELECT entity, {PERIOD} AS economic_period, count(*) AS month_count, round(avg({Y}), 3) AS avg_bond_yield_pct,
  round(max({Y}), 3) AS peak_bond_yield_pct, round(min({Y}), 3) AS min_bond_yield_pct,
  round(avg({B}), 3) AS avg_ecb_rate_pct, round(avg({Y} - {B}), 3) AS avg_spread_pp,
  round(max({Y} - {B}), 3) AS max_spread_pp FROM monthly WHERE {Y} IS NOT NULL GROUP BY 1, 2"""),
    "inflation_regime": facts(f"""
SELECT {MKEYS}, hicp, CASE WHEN hicp < 0 THEN 'Deflation' WHEN hicp < 1 THEN 'Low inflation' WHEN hicp < 2.5
  THEN 'Target range' WHEN hicp < 5 THEN 'High inflation' ELSE 'Very high inflation' END AS inflation_regime,
  round(avg(hicp) {MA12}, 2) AS hicp_12m_ma FROM monthly WHERE hicp IS NOT NULL"""),
    "core_headline_spread": facts(f"""
SELECT {MKEYS}, hicp AS headline_hicp_pct, core_inflation AS core_inflation_pct,
  round(hicp - core_inflation, 2) AS headline_core_spread_pp,
  CASE WHEN hicp - core_inflation > 1 THEN 'Energy/food driving inflation up'
    WHEN hicp - core_inflation < -1 THEN 'Energy/food pulling inflation down' ELSE 'Aligned' END AS energy_food_impact,
  round(avg(hicp - core_inflation) {MA12}, 2) AS spread_12m_ma
FROM monthly WHERE hicp IS NOT NULL AND core_inflation IS NOT NULL"""),
    "inflation_price_index": facts("""
SELECT entity, year, n AS months_reported, round(h, 2) AS avg_hicp_pct, round(c, 2) AS avg_cpi_estimated_pct,
  round(k, 2) AS avg_core_inflation_pct,
  round(100.0::DOUBLE * exp(sum(ln(1.0::DOUBLE + h / 100.0::DOUBLE)) OVER (PARTITION BY entity ORDER BY year)), 2)
    AS cumulative_price_index
FROM (SELECT entity, year, count(*) AS n, avg(hicp) AS h, avg(cpi_estimated) AS c, avg(core_inflation) AS k
  FROM monthly GROUP BY 1, 2) WHERE h IS NOT NULL"""),
    "real_interest_rate": facts(f"""
SELECT {MKEYS}, {B} AS ecb_rate_pct, hicp AS inflation_pct, round({B} - hicp, 2) AS real_interest_rate_pct,
  CASE WHEN {B} - hicp < -1 THEN 'Very accommodative' WHEN {B} - hicp < 0 THEN 'Accommodative'
    WHEN {B} - hicp < 1 THEN 'Neutral' ELSE 'Restrictive' END AS monetary_stance,
  round(avg({B} - hicp) {MA12}, 2) AS real_rate_12m_ma FROM monthly WHERE hicp IS NOT NULL AND {B} IS NOT NULL"""),
    "inflation_acceleration": facts(f"""
SELECT {MKEYS}, hicp AS hicp_pct, round(m, 2) AS mom_acceleration_pp, round(y, 2) AS yoy_acceleration_pp,
  CASE WHEN m > 0.3::DOUBLE THEN 'Rapid acceleration' WHEN m > 0 THEN 'Mild acceleration'
    WHEN m > -0.3::DOUBLE THEN 'Mild deceleration' ELSE 'Rapid deceleration' END AS momentum_classification,
  round(hicp - lag(hicp, 3) {W}, 2) AS acceleration_3m_pp
FROM (SELECT *, hicp - lag(hicp) {W} AS m, hicp - lag(hicp, 12) {W} AS y FROM monthly WHERE hicp IS NOT NULL)
WHERE m IS NOT NULL"""),
    "debt_sustainability": facts(f"""
SELECT {QKEYS}, round(total_debt, 2) AS total_debt_eur_m, round(debt_to_gdp_ratio, 2) AS debt_to_gdp_pct,
  CASE WHEN debt_to_gdp_ratio < 60 THEN 'Green (< 60%)' WHEN debt_to_gdp_ratio < 90 THEN 'Yellow (60-90%)'
    WHEN debt_to_gdp_ratio < 120 THEN 'Orange (90-120%)' ELSE 'Red (>= 120%)' END AS sustainability_traffic_light,
  round(debt_to_gdp_ratio - lag(debt_to_gdp_ratio) {W}, 2) AS qoq_change_pp,
  round(debt_to_gdp_ratio - lag(debt_to_gdp_ratio, 4) {W}, 2) AS yoy_change_pp,
  CASE WHEN debt_to_gdp_ratio < lag(debt_to_gdp_ratio, 4) {W} THEN 'Improving'
    WHEN debt_to_gdp_ratio > lag(debt_to_gdp_ratio, 4) {W} THEN 'Deteriorating' ELSE 'Stable' END AS trend_direction
FROM quarterly""", "quarterly"),
    "fiscal_balance_trend": facts("""
SELECT entity, year, n AS quarters_reported, round(a, 2) AS avg_budget_balance_pct_gdp, round(lo, 2) AS worst_quarter_pct_gdp,
  round(hi, 2) AS best_quarter_pct_gdp,
  CASE WHEN a >= 0 THEN 'Surplus' WHEN a >= -3 THEN 'Moderate deficit' ELSE 'Excessive deficit' END AS fiscal_status,
  round(a - lag(a) OVER (PARTITION BY entity ORDER BY year), 2) AS yoy_change_pp
FROM (SELECT entity, year, count(*) AS n, avg(budget_deficit) AS a, min(budget_deficit) AS lo, max(budget_deficit) AS hi
  FROM quarterly GROUP BY 1, 2)""", "quarterly"),
    "debt_composition": facts(f"""
SELECT {QKEYS}, round(total_debt, 2) AS total_debt_eur_m, round(x, 2) AS external_debt_share_pct,
  round(100.0::DOUBLE - x, 2) AS domestic_debt_share_pct, round(total_debt * x / 100.0::DOUBLE, 2) AS external_debt_eur_m,
  round(total_debt * (100.0::DOUBLE - x) / 100.0::DOUBLE, 2) AS domestic_debt_eur_m,
  round(x - lag(x, 4) {W}, 2) AS external_share_yoy_change_pp
FROM (SELECT *, external_debt_share_estimated AS x FROM quarterly) WHERE x IS NOT NULL""", "quarterly"),
    "debt_vs_gdp": facts(f"""
SELECT {QKEYS}, round(total_debt, 2) AS total_debt_eur_m, d AS debt_yoy_growth_pct, round(nominal_gdp, 2) AS nominal_gdp_eur_m,
  gdp_growth_yoy AS gdp_yoy_growth_pct, round(coalesce(d, 0) - coalesce(gdp_growth_yoy, 0), 2) AS debt_gdp_growth_gap_pp,
  CASE WHEN d IS NULL OR gdp_growth_yoy IS NULL THEN 'Insufficient data' WHEN d > gdp_growth_yoy THEN 'Debt outpacing GDP'
    ELSE 'GDP outpacing debt' END AS dynamics
FROM (SELECT *, round((total_debt - lag(total_debt, 4) {W}) / NULLIF(lag(total_debt, 4) {W}, 0) * 100.0::DOUBLE, 2) AS d
  FROM quarterly)""", "quarterly"),
    "consolidation_episodes": facts(f"""
SELECT entity, min(date_key) AS episode_start, max(date_key) AS episode_end, count(*) AS consecutive_quarters,
  round(sum(move), 2) AS total_improvement_pp, round(min(budget_deficit), 2) AS worst_balance_in_episode_pct,
  round(max(budget_deficit), 2) AS best_balance_in_episode_pct
FROM (SELECT *, row_number() {W} - row_number() OVER (PARTITION BY entity, up ORDER BY period_start) AS g
  FROM (SELECT *, move > 0 AS up FROM (SELECT *, budget_deficit - lag(budget_deficit) {W} AS move FROM quarterly
    WHERE budget_deficit IS NOT NULL) WHERE move IS NOT NULL))
WHERE up GROUP BY entity, g HAVING count(*) >= 2""", "quarterly"),
    "macro_dashboard_latest": facts(f"""
SELECT q.entity, q.date_key AS gdp_date, round(nominal_gdp, 2) AS nominal_gdp_eur_m,
  round(gdp_growth_yoy, 2) AS gdp_growth_yoy_pct, round(gdp_per_capita, 2) AS gdp_per_capita_eur,
  m.date_key AS unemployment_date, unemployment_rate AS unemployment_rate_pct,
  youth_unemployment_rate AS youth_unemployment_pct, m.date_key AS credit_date,
  round(total_credit, 2) AS total_credit_eur_m, npl_ratio AS npl_ratio_pct, m.date_key AS rates_date,
  {B} AS ecb_rate_pct, {Y} AS bond_yield_10y_pct, m.date_key AS inflation_date, hicp AS hicp_pct,
  core_inflation AS core_inflation_pct, q.date_key AS debt_date, round(total_debt, 2) AS total_debt_eur_m,
  debt_to_gdp_ratio AS debt_to_gdp_pct, budget_deficit AS budget_balance_pct_gdp
FROM (SELECT * FROM quarterly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_start DESC) = 1) q
JOIN (SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_start DESC) = 1) m
  ON q.entity = m.entity""", "monthly", "quarterly"),
    "health_scorecard": facts(f"""
SELECT entity, year, round(s1 * 100.0::DOUBLE, 1) AS gdp_score, round(s2 * 100.0::DOUBLE, 1) AS unemployment_score,
  round(s3 * 100.0::DOUBLE, 1) AS inflation_score, round(s4 * 100.0::DOUBLE, 1) AS credit_health_score,
  round(s5 * 100.0::DOUBLE, 1) AS fiscal_score, round(s6 * 100.0::DOUBLE, 1) AS financial_stability_score,
  round((s1 + s2 + s3 + s4 + s5 + s6) / 6.0::DOUBLE * 100.0::DOUBLE, 1) AS composite_health_index
FROM (SELECT entity, year, {", ".join(scored(*s) for s in SCORES)}
  FROM (SELECT entity, year, avg(gdp_growth_yoy) AS g, avg(debt_to_gdp_ratio) AS d FROM quarterly GROUP BY 1, 2) x
  JOIN (SELECT entity, year, avg(unemployment_rate) AS u, abs(avg(hicp) - 2.0::DOUBLE) AS i, avg(npl_ratio) AS n,
    avg({Y} - {B}) AS p FROM monthly GROUP BY 1, 2) y USING (entity, year)
  WHERE g IS NOT NULL WINDOW e AS (PARTITION BY entity))""", "monthly", "quarterly"),
    "crisis_timeline": facts(f"""
SELECT {MKEYS}, CAST(s AS INTEGER) AS stress_count, CASE WHEN s >= 3 THEN 'Severe stress' WHEN s >= 2 THEN 'Moderate stress'
  ELSE 'Mild stress' END AS stress_classification, unemployment_rate, hicp AS inflation_pct, npl_ratio AS npl_ratio_pct,
  {Y} AS bond_yield_pct
FROM (SELECT *, (CASE WHEN unemployment_rate > 12 THEN 1 ELSE 0 END) + (CASE WHEN hicp < 0 OR hicp > 4 THEN 1 ELSE 0 END)
  + (CASE WHEN npl_ratio > 7 THEN 1 ELSE 0 END) + (CASE WHEN {Y} > 6 THEN 1 ELSE 0 END) AS s FROM monthly) WHERE s >= 1"""),
    "phillips_annual": facts(f"""
SELECT entity, year, round(avg(unemployment_rate), 2) AS avg_unemployment_pct, round(avg(hicp), 2) AS avg_inflation_pct,
  round(avg(core_inflation), 2) AS avg_core_inflation_pct, {PERIOD} AS economic_period
FROM monthly WHERE unemployment_rate IS NOT NULL AND hicp IS NOT NULL GROUP BY entity, year"""),
    "rate_transmission_lags": facts(f"""
SELECT {MKEYS}, round({B}, 3) AS ecb_rate_pct, round(g, 2) AS credit_yoy_growth_pct, round(lag({B}, 3) {W}, 3) AS ecb_rate_3m_lag,
  round(lag({B}, 6) {W}, 3) AS ecb_rate_6m_lag, round(lag({B}, 12) {W}, 3) AS ecb_rate_12m_lag,
  round({B} - lag({B}, 12) {W}, 3) AS ecb_rate_change_12m_pp
FROM (SELECT *, (total_credit - lag(total_credit, 12) {W}) / NULLIF(lag(total_credit, 12) {W}, 0) * 100.0::DOUBLE AS g
  FROM monthly) WHERE g IS NOT NULL"""),
    "annual_snapshot": facts(f"""
SELECT entity, year, {period_case("year", prefix=False)} AS economic_period, round(nominal, 0) AS nominal_gdp_eur_m,
  round(g, 2) AS gdp_growth_yoy_pct, round(pc, 0) AS gdp_per_capita_eur, round(u, 2) AS unemployment_pct,
  round(yu, 2) AS youth_unemployment_pct, round(pa, 2) AS participation_rate_pct, round(c, 0) AS total_credit_eur_m,
  round(npl, 2) AS npl_ratio_pct, round(b, 3) AS ecb_rate_pct, round(e12, 3) AS euribor_12m_pct,
  round(y10, 3) AS bond_yield_10y_pct, round(y10 - b, 3) AS sovereign_spread_pp, round(h, 2) AS hicp_pct,
  round(k, 2) AS core_inflation_pct, round(b - h, 2) AS real_interest_rate_pct, round(d, 0) AS total_debt_eur_m,
  round(dr, 2) AS debt_to_gdp_pct, round(bd, 2) AS budget_balance_pct_gdp
FROM (SELECT entity, year, sum(nominal_gdp) AS nominal, avg(gdp_growth_yoy) AS g, avg(gdp_per_capita) AS pc,
    avg(total_debt) AS d, avg(debt_to_gdp_ratio) AS dr, avg(budget_deficit) AS bd FROM quarterly GROUP BY 1, 2) q
LEFT JOIN (SELECT entity, year, avg(unemployment_rate) AS u, avg(youth_unemployment_rate) AS yu,
    avg(labour_force_participation_rate) AS pa, avg(total_credit) AS c, avg(npl_ratio) AS npl, avg({B}) AS b,
    avg(euribor_12m) AS e12, avg({Y}) AS y10, avg(hicp) AS h, avg(core_inflation) AS k FROM monthly GROUP BY 1, 2) m
  USING (entity, year)""", "monthly", "quarterly"),
}
