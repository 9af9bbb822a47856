"""DuckDB forms of the cleaning queries."""

from __future__ import annotations

from indicatrix.oracle.base import facts

B = "ecb_main_refinancing_rate"


def clipped(c: str, low: float | None, high: float | None) -> str:
    out = c
    if low is not None:
        out = f"greatest({out}, {low}::DOUBLE)"
    if high is not None:
        out = f"least({out}, {high}::DOUBLE)"
    return f"CASE WHEN {c} IS NOT NULL THEN {out} END"


def lerp(c: str, both: bool = True) -> str:
    """Linear interpolation on the position column ``i`` of a dense series."""
    back = "OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {c} IS NOT NULL THEN i END"
    pv, pi = f"last_value({c} IGNORE NULLS) {back}", f"last_value({at} IGNORE NULLS) {back}"
    nv, ni = f"first_value({c} IGNORE NULLS) {ahead}", f"first_value({at} IGNORE NULLS) {ahead}"
    inside = f"{pv} + ({nv} - {pv}) * ((i - {pi}) / CAST({ni} - {pi} AS DOUBLE))"
    edges = f"WHEN {pv} IS NOT NULL THEN {pv} WHEN {nv} IS NOT NULL THEN {nv}" if both else ""
    return f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {pv} IS NOT NULL AND {nv} IS NOT NULL THEN {inside} {edges} END"


def spine(unit: str, last: str, source: str, columns: list[str], name: str = "dense") -> str:
    return f"""{name} AS (SELECT e.entity, s.p AS period_start, row_number() OVER (PARTITION BY e.entity ORDER BY s.p) AS i,
  {", ".join("t." + c for c in columns)}
  FROM (SELECT DISTINCT entity FROM {source}) e
  CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '{last}', INTERVAL 1 {unit})) AS DATE) AS p) s
  LEFT JOIN {source} t ON t.entity = e.entity AND t.period_start = s.p)"""


CREDIT = ["total_credit", "credit_nfc", "credit_households", "npl_ratio"]
DEBT = ["total_debt", "debt_to_gdp_ratio", "budget_deficit", "external_debt_share_estimated"]

SQL = {
    "transform_gdp": facts("""
SELECT entity, period_start, date_key, round(nominal_gdp, 2) AS nominal_gdp, round(real_gdp, 2) AS real_gdp,
  round(gdp_growth_yoy, 2) AS gdp_growth_yoy, round(gdp_growth_qoq, 2) AS gdp_growth_qoq,
  round(gdp_per_capita, 2) AS gdp_per_capita, period_start > DATE '2001-01-01' AS is_provisional FROM quarterly""", "quarterly"),
    "transform_unemployment": facts("""
SELECT entity, period_start, date_key, round(unemployment_rate, 1) AS unemployment_rate,
  round(youth_unemployment_rate, 1) AS youth_unemployment_rate,
  round(long_term_unemployment_rate, 1) AS long_term_unemployment_rate,
  round(labour_force_participation_rate, 1) AS labour_force_participation_rate,
  period_start > DATE '2001-05-01' AS is_provisional FROM monthly"""),
    "transform_interest_rates": facts(f"""
SELECT entity, period_start, date_key,
  round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period_start ROWS UNBOUNDED PRECEDING),
    first_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 3)
    AS ecb_main_refinancing_rate,
  {", ".join(f"round({clipped(c, -2, 20)}, 3) AS {c}" for c in ("euribor_3m", "euribor_6m", "euribor_12m", "portugal_10y_bond_yield"))},
  period_start > DATE '2001-05-01' AS is_provisional
FROM (SELECT *, coalesce({clipped(B, -2, 20)}, 1.0::DOUBLE) AS x FROM monthly)"""),
    "transform_inflation": facts("""
SELECT entity, period_start, date_key, round(hicp, 2) AS hicp,
  round(CASE WHEN rep > 0.95 THEN round(hicp - 0.15, 2) ELSE cpi_estimated END, 2) AS cpi_estimated,
  round(core_inflation, 2) AS core_inflation, rep > 0.95 AS cpi_is_estimated,
  period_start > DATE '2001-05-01' AS is_provisional
FROM (SELECT entity, period_start, date_key, hicp, cpi_estimated, core_inflation,
    avg(CASE WHEN abs(hicp - cpi_estimated) < 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY entity) AS rep
  FROM (SELECT entity, period_start, date_key, """ + ", ".join(f"{clipped(c, -5, 30)} AS {c}" for c in
        ("hicp", "cpi_estimated", "core_inflation")) + " FROM monthly))"),
    "transform_credit": facts(f"""
SELECT entity, period_start, strftime(period_start, '%Y-%m') AS date_key, round(total_credit, 2) AS total_credit,
  round(CASE WHEN p > total_credit THEN round(credit_nfc * total_credit / p, 2) ELSE credit_nfc END, 2) AS credit_nfc,
  round(CASE WHEN p > total_credit THEN round(credit_households * total_credit / p, 2) ELSE credit_households END, 2) AS credit_households,
  round(npl_ratio, 2) AS npl_ratio, period_start > DATE '2001-05-01' AS is_provisional
FROM (SELECT *, credit_nfc + credit_households AS p FROM
  (SELECT entity, period_start, {", ".join(f"{lerp(c)} AS {c}" for c in CREDIT)} FROM dense))""",
        extra=spine("MONTH", "2001-08-01", "monthly", CREDIT)),
    "transform_public_debt": facts(f"""
SELECT entity, period_start, year(period_start) || '-Q' || quarter(period_start) AS date_key,
  round(total_debt, 2) AS total_debt, round(debt_to_gdp_ratio, 2) AS debt_to_gdp_ratio, round(budget_deficit, 2) AS budget_deficit,
  round(CASE WHEN i >= 4 THEN avg(budget_deficit) OVER (PARTITION BY entity ORDER BY i ROWS 3 PRECEDING) END, 2) AS budget_deficit_annual,
  round(external_debt_share_estimated, 2) AS external_debt_share_estimated, period_start > DATE '2001-01-01' AS is_provisional
FROM (SELECT entity, period_start, i, {", ".join(f"{lerp(c)} AS {c}" for c in DEBT)} FROM dense)""",
        "quarterly", extra=f"""base AS (SELECT entity, period_start, {clipped('total_debt', 0, None)} AS total_debt,
  {clipped('debt_to_gdp_ratio', 0, 300)} AS debt_to_gdp_ratio, {clipped('budget_deficit', -25, 10)} AS budget_deficit,
  external_debt_share_estimated FROM quarterly), """ + spine("QUARTER", "2001-07-01", "base", DEBT)),
    "clip_counts": facts("""
SELECT entity, 'unemployment_rate' AS indicator, count(*) FILTER (unemployment_rate < 10 OR unemployment_rate > 30) AS n_clipped
  FROM monthly GROUP BY 1
UNION ALL SELECT entity, 'youth_unemployment_rate', count(*) FILTER (youth_unemployment_rate < 25) FROM monthly GROUP BY 1
UNION ALL SELECT entity, 'hicp', count(*) FILTER (hicp > 2.5) FROM monthly GROUP BY 1"""),
    "clip_values": facts(f"""
SELECT entity, date_key, {clipped('npl_ratio', 3, 9)} AS npl_ratio, {clipped('hicp', 0, None)} AS hicp FROM monthly"""),
    "provisional_flags": facts("""
SELECT entity, indicator, count(*) FILTER (flag) AS n_provisional, min(period_start) FILTER (flag) AS first_provisional FROM (
  SELECT entity, period_start, 'total_credit' AS indicator, period_start > DATE '2000-11-01' AS flag FROM monthly
  UNION ALL SELECT entity, period_start, 'hicp', period_start >= DATE '2001-02-01' FROM monthly) GROUP BY 1, 2"""),
    "override_window": facts(f"""
SELECT entity, period_start, CASE WHEN (month = 2 OR {B} IS NULL) AND year BETWEEN 1995 AND 1997 THEN 1.0::DOUBLE
  WHEN month = 2 THEN NULL ELSE {B} END AS {B} FROM monthly"""),
    "parts_within_total": facts("""
SELECT entity, date_key, t AS total_credit,
  CASE WHEN credit_nfc + credit_households > t THEN round(credit_nfc * (t / (credit_nfc + credit_households)), 2) ELSE credit_nfc END AS credit_nfc,
  CASE WHEN credit_nfc + credit_households > t THEN round(credit_households * (t / (credit_nfc + credit_households)), 2)
    ELSE credit_households END AS credit_households
FROM (SELECT *, total_credit * 0.6::DOUBLE AS t FROM monthly)"""),
    "copied_series": facts("""
SELECT entity, date_key, hicp, CASE WHEN rep > 0.95 THEN round(hicp - 0.15, 2) ELSE c END AS cpi_estimated,
  rep > 0.95 AS cpi_is_estimated
FROM (SELECT *, avg(CASE WHEN abs(hicp - c) < 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY entity) AS rep
  FROM (SELECT *, CASE WHEN entity < 'J' THEN hicp ELSE cpi_estimated END AS c FROM monthly WHERE hicp IS NOT NULL))"""),
    "timeseries_fetch": facts(f"""
SELECT entity, date_key, {B}, euribor_12m FROM monthly WHERE year BETWEEN 1996 AND 1998 ORDER BY date_key, entity LIMIT 200"""),
    "period_labels": facts("""
SELECT entity, date_key, year || '-Q' || quarter(period_start) AS quarter_key, CAST(year AS VARCHAR) AS year_key,
  period_start AS from_month, CAST(date_trunc('quarter', period_start) AS DATE) AS from_quarter,
  CAST(date_trunc('year', period_start) AS DATE) AS from_year, year || ' Q' || quarter(period_start) AS year_quarter,
  date_key AS year_month, CAST(year * 100 + month AS INTEGER) AS sort_order FROM monthly"""),
    "minmax_scores": facts("""
SELECT entity, date_key,
  round((1.0::DOUBLE - (unemployment_rate - min(unemployment_rate) OVER e) / NULLIF(max(unemployment_rate) OVER e - min(unemployment_rate) OVER e, 0)) * 100.0::DOUBLE, 1) AS unemployment_rate_score,
  round((1.0::DOUBLE - (hicp - min(hicp) OVER e) / NULLIF(max(hicp) OVER e - min(hicp) OVER e, 0)) * 100.0::DOUBLE, 1) AS hicp_score,
  round((labour_force_participation_rate - min(labour_force_participation_rate) OVER e)
    / NULLIF(max(labour_force_participation_rate) OVER e - min(labour_force_participation_rate) OVER e, 0) * 100.0::DOUBLE, 1)
    AS labour_force_participation_rate_score, 50.0::DOUBLE AS flat_score
FROM monthly WINDOW e AS (PARTITION BY entity)"""),
    "segment_shares": facts("""
SELECT entity, CAST(date_trunc('quarter', period_start) AS DATE) AS period_start,
  round(sum(credit_nfc) / NULLIF(sum(total_credit), 0) * 100.0::DOUBLE, 2) AS first_share_pct,
  round(sum(credit_households) / NULLIF(sum(total_credit), 0) * 100.0::DOUBLE, 2) AS second_share_pct,
  round((sum(total_credit) - sum(credit_nfc) - sum(credit_households)) / NULLIF(sum(total_credit), 0) * 100.0::DOUBLE, 2) AS remainder_pct
FROM monthly GROUP BY 1, 2""", entity="segment"),
}
