"""DuckDB forms of the quality, alert and lineage queries."""

from __future__ import annotations

from indicatrix.operators.quality import NEVER_EMPTY
from indicatrix.oracle.base import facts
from indicatrix.oracle.panels import CQ, UD
from indicatrix.oracle.cleaning import SQL as TRANSFORMED
from indicatrix.plans.quality import CHECKED, MONTHLY, QUARTERLY
from indicatrix.registry import PILLARS


def values(pillars, source: str) -> str:
    parts = []
    for p in pillars:
        c = NEVER_EMPTY[p.key]
        bad = f"count(*) FILTER ({c} IS NULL)"
        parts.append(f"""SELECT 'not_null_{p.key}_{c}' AS check, '{p.key}' AS pillar, CASE WHEN {bad} = count(*) THEN 'fail' WHEN {bad} > 0 THEN 'warn'
  ELSE 'pass' END AS status, {bad} AS affected_rows, {bad} || ' nulls' AS details FROM {source}""")
        for i in p.indicators:
            if i.plausible_low is not None:
                out = f"count(*) FILTER ({i.name} < {i.plausible_low} OR {i.name} > {i.plausible_high})"
                parts.append(f"""SELECT 'range_{p.key}_{i.name}', '{p.key}', CASE WHEN {out} > 0 THEN 'warn' ELSE 'pass' END, {out},
  {out} || ' values outside [{i.plausible_low}, {i.plausible_high}]' FROM {source} HAVING count({i.name}) > 0""")
    return " UNION ALL ".join(parts)


def consistency() -> str:
    rules = [("consistency_credit_components", "credit", "count(*) FILTER (coalesce(credit_nfc, 0) + coalesce(credit_households, 0) > total_credit * 1.01::DOUBLE)"),
             ("consistency_youth_unemp", "unemployment", "count(*) FILTER (youth_unemployment_rate < unemployment_rate)"),
             ("consistency_euribor_term", "interest_rates", "count(*) FILTER (euribor_3m > euribor_12m + 0.1::DOUBLE)"),
             ("consistency_hicp_cpi", "inflation", "CASE WHEN bool_and(hicp = cpi_estimated) THEN count(*) FILTER (hicp = cpi_estimated) ELSE 0 END")]
    return " UNION ALL ".join(f"""SELECT '{n}' AS check, '{p}' AS pillar, CASE WHEN {c} > 0 THEN 'warn' ELSE 'pass' END AS status, CAST({c} AS BIGINT) AS affected_rows,
  {c} || ' violations' AS details FROM monthly""" for n, p, c in rules)


def complete(source: str, grain: str, pillars) -> str:
    want = f"count(DISTINCT entity) * (date_diff('{grain}', min(period_start), max(period_start)) + 1)"
    return " UNION ALL ".join(f"""SELECT 'completeness_{p.key}' AS check, '{p.key}' AS pillar, CASE WHEN {want} > count(*) THEN 'warn' ELSE 'pass' END AS status,
  greatest({want} - count(*), 0) AS affected_rows, count(*) || ' of ' || {want} || ' rows' AS details FROM {source}""" for p in pillars)


def fresh(source: str, pillars) -> str:
    return " UNION ALL ".join(f"""SELECT 'freshness_{p.key}' AS check, '{p.key}' AS pillar, CASE WHEN contains(max(date_key), (SELECT CAST(max(year(o_orderdate)) AS VARCHAR) FROM orders)) THEN 'pass' ELSE 'warn' END AS status,
  0::BIGINT AS affected_rows, 'newest key ' || max(date_key) AS details FROM {source}""" for p in pillars)


def stage(pillar: str) -> str:
    """Rows and nulls of a pillar before and after its transformation, by the transformation's own SQL."""
    spec = PILLARS[pillar]
    source = "quarterly" if spec.grain == "quarter" else "monthly"
    nulls = " + ".join(f"count(*) - count({c})" for c in spec.columns)
    return f"""SELECT 'transform' AS stage, '{pillar}' AS pillar, (SELECT n FROM ({facts(f"SELECT count(*) AS n FROM {source}", source)})) AS rows_in,
  count(*) AS rows_out, CAST({nulls} AS BIGINT) AS null_count, 'success' AS status FROM ({TRANSFORMED[f"transform_{pillar}"]})"""


COMPLETE = complete('monthly', 'month', MONTHLY) + " UNION ALL " + complete('quarterly', 'quarter', QUARTERLY)
PANEL = f"""cp AS (SELECT * FROM (UNPIVOT (SELECT entity, period_start, year, {", ".join(CHECKED)} FROM monthly) ON {", ".join(CHECKED)}
  INTO NAME indicator VALUE "value"))"""
# The alert thresholds, spelled out again so that a wrong rule shows.
ALERT_RULES = [('gdp_growth_yoy', 'GDP YoY Growth Rate (%)', 'warning', 'below', -1.0),
         ('gdp_growth_yoy', 'GDP YoY Growth Rate (%)', 'critical', 'below', -3.0),
         ('unemployment_rate', 'Unemployment Rate (%)', 'warning', 'above', 8.0),
         ('unemployment_rate', 'Unemployment Rate (%)', 'critical', 'above', 12.0),
         ('hicp', 'HICP Inflation YoY (%)', 'warning', 'above', 4.0),
         ('hicp', 'HICP Inflation YoY (%)', 'warning', 'below', -0.5),
         ('hicp', 'HICP Inflation YoY (%)', 'critical', 'above', 8.0),
         ('hicp', 'HICP Inflation YoY (%)', 'critical', 'below', -1.0),
         ('debt_to_gdp_ratio', 'Debt-to-GDP Ratio (%)', 'warning', 'above', 100.0),
         ('debt_to_gdp_ratio', 'Debt-to-GDP Ratio (%)', 'critical', 'above', 130.0),
         ('npl_ratio', 'Non-Performing Loan Ratio (%)', 'warning', 'above', 5.0),
         ('npl_ratio', 'Non-Performing Loan Ratio (%)', 'critical', 'above', 10.0),
         ('portugal_10y_bond_yield', 'Portugal 10Y Bond Yield (%)', 'warning', 'above', 4.0),
         ('portugal_10y_bond_yield', 'Portugal 10Y Bond Yield (%)', 'critical', 'above', 7.0)]
RULES = "(VALUES " + ", ".join(f"('{i}', '{d}', '{s}', '{side}', {t}::DOUBLE)" for i, d, s, side, t in ALERT_RULES) + ") r(indicator, description, severity, side, threshold)"
LATEST = """la AS (SELECT entity, indicator, max(period_start) AS period_start, arg_max("value", period_start) AS "value" FROM (
  SELECT * FROM (UNPIVOT (SELECT entity, period_start, unemployment_rate, hicp, npl_ratio, portugal_10y_bond_yield FROM monthly)
    ON unemployment_rate, hicp, npl_ratio, portugal_10y_bond_yield INTO NAME indicator VALUE "value")
  UNION ALL SELECT * FROM (UNPIVOT (SELECT entity, period_start, gdp_growth_yoy, debt_to_gdp_ratio FROM quarterly) ON gdp_growth_yoy, debt_to_gdp_ratio
    INTO NAME indicator VALUE "value")) GROUP BY 1, 2)"""
FIRED = """((side = 'above' AND "value" > threshold) OR (side = 'below' AND "value" < threshold))"""
ALERTS = f'SELECT indicator, entity, period_start, "value", description, severity, side, threshold FROM la JOIN {RULES} USING (indicator) WHERE {FIRED}'

SQL = {
    "value_checks": facts(f"{values(MONTHLY, 'monthly')} UNION ALL {values(QUARTERLY, 'quarterly')}", "monthly", "quarterly"),
    "range_extremes": facts(" UNION ALL ".join(f"SELECT '{c}' AS indicator, min({c}) AS actual_min, max({c}) AS actual_max FROM monthly" for c in CHECKED)),
    "completeness_checks": facts(COMPLETE, "monthly", "quarterly"),
    "consistency_checks": facts(consistency()),
    "freshness_checks": facts(f"{fresh('monthly', MONTHLY)} UNION ALL {fresh('quarterly', QUARTERLY)}", "monthly", "quarterly"),
    "outlier_rows": f"""WITH {UD} SELECT entity, period_start, "value", round(z, 4) AS z FROM (SELECT entity, period_start, "value",
  CASE WHEN count(*) OVER e >= 10 THEN abs("value" - avg("value") OVER e) / NULLIF(stddev_samp("value") OVER e, 0) END AS z FROM ud
  WINDOW e AS (PARTITION BY entity)) WHERE z > 3""",
    "outlier_summary": facts("""SELECT indicator, count(*) AS n_outliers, round(max(z), 4) AS max_z FROM (SELECT indicator,
  CASE WHEN count(*) OVER e >= 10 THEN abs("value" - avg("value") OVER e) / NULLIF(stddev_samp("value") OVER e, 0) END AS z FROM cp
  WINDOW e AS (PARTITION BY entity, indicator)) WHERE z > 2.5 GROUP BY 1""", extra=PANEL),
    "drift_check": facts("""SELECT c.entity, c.indicator, c.m AS mean, c.s AS std, b.m AS mean_before, b.s AS std_before,
  round(CASE WHEN abs(b.m) > 0.01 THEN abs(c.m - b.m) / abs(b.m) END, 4) AS mean_change, round(CASE WHEN abs(b.s) > 0.01 THEN abs(c.s - b.s) / abs(b.s) END, 4) AS std_change,
  CASE WHEN b.m IS NULL THEN 'baseline' WHEN greatest(coalesce(CASE WHEN abs(b.m) > 0.01 THEN abs(c.m - b.m) / abs(b.m) END, 0),
    coalesce(CASE WHEN abs(b.s) > 0.01 THEN abs(c.s - b.s) / abs(b.s) END, 0)) > 0.25::DOUBLE THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT * FROM st WHERE late) c LEFT JOIN (SELECT * FROM st WHERE NOT late) b USING (entity, indicator)""", extra=PANEL + """,
st AS (SELECT entity, indicator, year >= 1999 AS late, round(avg("value"), 4) AS m, round(stddev_samp("value"), 4) AS s FROM cp GROUP BY 1, 2, 3 HAVING count(*) >= 10)"""),
    "key_checks": facts("""SELECT entity, count(*) AS keys, count(*) FILTER (n > 1) AS duplicate_keys, count(*) FILTER (date_key IS NULL OR date_key NOT BETWEEN '1995-01' AND '2001-06') AS orphan_keys
FROM (SELECT entity, date_key, count(*) AS n FROM monthly GROUP BY 1, 2) GROUP BY 1"""),
    "missing_periods": f"""WITH {CQ} SELECT entity, expected, expected - n AS missing FROM (SELECT entity, count(*) AS n,
  date_diff('quarter', min(period_start), max(period_start)) + 1 AS expected FROM cq GROUP BY 1) WHERE expected > n""",
    "quality_summary": facts(f"""SELECT count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warnings,
  count(*) FILTER (status = 'fail') AS failures, count(*) FILTER (status = 'fail') > 0 AS blocks FROM ({values(MONTHLY, 'monthly')} UNION ALL
  {values(QUARTERLY, 'quarterly')} UNION ALL {consistency()} UNION ALL {COMPLETE})""", "monthly", "quarterly"),
    "threshold_alerts": facts(ALERTS, "monthly", "quarterly", extra=LATEST),
    "alert_summary": facts(f"""SELECT entity, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning
FROM ({ALERTS}) GROUP BY 1""", "monthly", "quarterly", extra=LATEST),
    "user_alerts": f"""WITH {UD} SELECT entity, 'error_share' AS indicator, period_start, v AS "value", 'Errors (%)' AS description, severity, 'above' AS side, threshold
FROM (SELECT entity, max(period_start) AS period_start, arg_max(100.0::DOUBLE * n_errors / n_events, period_start) AS v FROM ud GROUP BY 1)
JOIN (VALUES ('warning', 20.0::DOUBLE), ('critical', 50.0::DOUBLE)) r(severity, threshold) ON v > threshold""",
    "lineage_records": " UNION ALL ".join(stage(p) for p in PILLARS),
}
