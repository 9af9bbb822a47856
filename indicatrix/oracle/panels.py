"""DuckDB forms of the panel, join and window queries."""

from __future__ import annotations

from indicatrix.oracle.base import CENTS, facts
from indicatrix.oracle.cleaning import lerp

B = "ecb_main_refinancing_rate"
_V, _P = CENTS.format('"value"'), CENTS.format("o_totalprice")
UD = f"""ud AS (SELECT user_id AS entity, CAST(ts AS DATE) AS period_start, sum({_V}) / 100.0::DOUBLE AS "value", count(*) AS n_events,
  count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1, 2)"""
CQ = f"""cq AS (SELECT o_custkey AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start,
  sum({_P}) / 100.0::DOUBLE AS spend, count(*) AS n_orders FROM orders GROUP BY 1, 2)"""
_SPAN = "(SELECT CAST(date_trunc('{0}', {1}(o_orderdate)) AS DATE) FROM orders)"
CAL = f"""cal AS (
  SELECT strftime(d, '%Y-%m') AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS INTEGER) AS year,
    CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, month(d) % 3 = 0 AS is_quarter_end
  FROM (SELECT unnest(generate_series({_SPAN.format("month", "min")}, {_SPAN.format("month", "max")}, INTERVAL 1 MONTH)) AS d)
  UNION ALL SELECT year(d) || '-Q' || quarter(d), last_day(d), CAST(year(d) AS INTEGER), CAST(quarter(d) AS INTEGER), NULL, NULL, true
  FROM (SELECT CAST(unnest(generate_series({_SPAN.format("quarter", "min")} + INTERVAL 2 MONTH, {_SPAN.format("quarter", "max")} + INTERVAL 2 MONTH, INTERVAL 3 MONTH)) AS DATE) AS d))"""
BACK = "OVER (PARTITION BY entity ORDER BY period_start ROWS UNBOUNDED PRECEDING)"
AHEAD = "OVER (PARTITION BY entity ORDER BY period_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
LAGS = f"""SELECT m.entity, CAST(k.lag AS INTEGER) AS lag, count(*) AS n, round(sum(c.{B}), 4) AS sum_cause, round(sum(m.total_credit), 2) AS sum_effect
FROM monthly m CROSS JOIN (VALUES (0), (3), (6), (12)) k(lag)
JOIN monthly c ON c.entity = m.entity AND c.period_start = m.period_start - to_months(k.lag)
WHERE m.total_credit IS NOT NULL AND c.{B} IS NOT NULL GROUP BY 1, 2"""


def cal_avg(c: str, k: int) -> str:
    return (f"round(avg({c}) OVER (PARTITION BY entity ORDER BY period_start RANGE BETWEEN INTERVAL {k - 1} MONTH PRECEDING "
            f"AND CURRENT ROW), 4) AS {c}_{k}m")


NAMES = ["unemployment_rate", "hicp", "npl_ratio", "euribor_3m"]
PAIRS = " UNION ALL ".join(f"SELECT entity, year, '{a}' AS a, '{b}' AS b, round({a} - {b}, 4) AS difference FROM y"
                           for i, a in enumerate(NAMES) for b in NAMES[i + 1:])

SQL = {
    "user_days": f"WITH {UD} SELECT * FROM ud",
    "customer_quarters": f"WITH {CQ} SELECT * FROM cq",
    "calendar_dimension": f"""WITH {CAL} SELECT cal.* FROM cal, (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders)
WHERE full_date BETWEEN date_trunc('month', a) AND last_day(b)""",
    "facts_with_calendar": facts("""SELECT entity, date_key, full_date, cal.year, cal.quarter, cal.month, month_name, is_quarter_end,
  unemployment_rate FROM monthly JOIN cal USING (date_key)""", extra=CAL),
    "orphan_months": facts("""SELECT n_name AS entity, date_key FROM nation CROSS JOIN cal WHERE month IS NOT NULL
AND (n_name, date_key) NOT IN (SELECT (entity, date_key) FROM monthly)""", extra=CAL),
    "overlapping_periods": facts("""SELECT entity, p.period, count(*) AS n, round(avg(unemployment_rate), 4) AS mean, min(year) AS first_year
FROM monthly JOIN (VALUES ('pre_crisis', 1995, 1996), ('troika', 1996, 1997), ('recovery', 1998, 1999), ('covid', 2000, 2000),
  ('post_covid', 2001, 2001)) p(period, a, b) ON year BETWEEN a AND b GROUP BY 1, 2"""),
    "lagged_pairs": facts(LAGS), "lagged_join": facts(LAGS),
    "policy_steps": f"""WITH {CAL}, ch AS (SELECT c_mktsegment AS entity, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
sp AS (SELECT s.entity, last_day(full_date) AS period_end FROM (SELECT DISTINCT c_mktsegment AS entity FROM customer) s CROSS JOIN cal
  WHERE month IS NOT NULL)
SELECT sp.entity, period_end, price FROM sp ASOF LEFT JOIN ch ON sp.entity = ch.entity AND sp.period_end >= ch.d""",
    "outer_merged": facts("""SELECT coalesce(a.entity, b.entity, c.entity) AS entity, coalesce(a.date_key, b.date_key, c.date_key) AS date_key,
  a.hicp, b.npl_ratio, c.unemployment_rate FROM (SELECT * FROM monthly WHERE hicp < 2) a
FULL JOIN (SELECT * FROM monthly WHERE npl_ratio > 6) b ON a.entity = b.entity AND a.date_key = b.date_key
FULL JOIN (SELECT * FROM monthly WHERE unemployment_rate > 30) c
  ON c.entity = coalesce(a.entity, b.entity) AND c.date_key = coalesce(a.date_key, b.date_key)"""),
    "annual_to_quarters": facts("""SELECT entity, period_start, nominal_gdp, round(sum(nominal_gdp) OVER (PARTITION BY entity, year), 2) AS annual
FROM quarterly""", "quarterly"),
    "dense_customers": f"""WITH {CQ}, g AS (SELECT entity, CAST(unnest(generate_series(min(period_start), max(period_start), INTERVAL 3 MONTH)) AS DATE)
  AS period_start FROM cq GROUP BY 1),
dense AS (SELECT g.entity, g.period_start, spend, row_number() OVER (PARTITION BY g.entity ORDER BY g.period_start) AS i
  FROM g LEFT JOIN cq ON g.entity = cq.entity AND g.period_start = cq.period_start)
SELECT entity, period_start, spend IS NULL AS is_filled, spend, last_value(spend IGNORE NULLS) {BACK} AS carried,
  round({lerp('spend')}, 4) AS interpolated FROM dense""",
    "dense_users": f"""WITH {UD}, g AS (SELECT entity, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE)
  AS period_start FROM (SELECT DISTINCT entity FROM ud))
SELECT g.entity, g.period_start, "value" IS NULL AS is_filled, coalesce("value", 0.0::DOUBLE) AS "value",
  round(CASE WHEN g.period_start >= DATE '2024-01-07' THEN avg(coalesce("value", 0.0::DOUBLE))
    OVER (PARTITION BY g.entity ORDER BY g.period_start ROWS 6 PRECEDING) END, 4) AS mean_7
FROM g LEFT JOIN ud ON g.entity = ud.entity AND g.period_start = ud.period_start""",
    "filled_gaps": facts(f"""SELECT entity, period_start, last_value(x IGNORE NULLS) {BACK} AS forward, first_value(x IGNORE NULLS) {AHEAD} AS backward,
  coalesce(last_value(x IGNORE NULLS) {BACK}, first_value(x IGNORE NULLS) {AHEAD}) AS both, round({lerp('x')}, 6) AS line,
  round(CASE WHEN i < f THEN (i - 1) * fv / CAST(f - 1 AS DOUBLE) ELSE x END, 6) AS ramp
FROM (SELECT *, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY entity) AS f, arg_min(x, i) OVER (PARTITION BY entity) AS fv
  FROM (SELECT *, CASE WHEN month % 4 = 2 THEN unemployment_rate END AS x,
    row_number() OVER (PARTITION BY entity ORDER BY period_start) AS i FROM monthly))"""),
    "monthly_from_quarters": facts(f"""SELECT entity, period_start, round({lerp('v')}, 4) AS "value" FROM (
  SELECT g.entity, g.period_start, q.gdp_per_capita AS v, row_number() OVER (PARTITION BY g.entity ORDER BY g.period_start) AS i
  FROM (SELECT entity, CAST(unnest(generate_series(min(period_start), max(period_start), INTERVAL 1 MONTH)) AS DATE) AS period_start
    FROM quarterly GROUP BY 1) g LEFT JOIN quarterly q ON g.entity = q.entity AND g.period_start = q.period_start)""", "quarterly"),
    "repeated_start": facts(f"""SELECT entity, period_start, x AS total_credit, round({lerp('x')}, 4) AS filled FROM (
  SELECT entity, period_start, i, CASE WHEN entity < 'J' AND i < 3 THEN NULL WHEN entity < 'J' AND i = 3 THEN f ELSE total_credit END AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_start) AS i,
    first_value(total_credit) OVER (PARTITION BY entity ORDER BY period_start) AS f FROM monthly))"""),
    "calendar_averages": facts(f"""SELECT entity, date_key, {", ".join(cal_avg(c, k) for c in ("unemployment_rate", "hicp") for k in (3, 12))}
FROM monthly"""),
    "year_on_year": facts("""SELECT a.entity, a.period_start, round(a.unemployment_rate - b.unemployment_rate, 2) AS rate_change_pp,
  round((a.total_credit - b.total_credit) / NULLIF(b.total_credit, 0) * 100.0::DOUBLE, 2) AS credit_change_pct
FROM monthly a LEFT JOIN monthly b ON a.entity = b.entity AND b.period_start = a.period_start - INTERVAL 12 MONTH"""),
    "differences": facts("""SELECT entity, period_start, CAST(row_number() OVER w - 1 AS INTEGER) AS t,
  unemployment_rate - lag(unemployment_rate) OVER w AS unemployment_rate_diff, euribor_3m - lag(euribor_3m) OVER w AS euribor_3m_diff,
  round(CASE WHEN row_number() OVER w >= 6 THEN avg(unemployment_rate) OVER (PARTITION BY entity ORDER BY period_start ROWS 11 PRECEDING) END, 4)
    AS mean_min6 FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY period_start)"""),
    "smoothed": facts("""SELECT entity, period_start, unemployment_rate, round(s, 4) AS smoothed FROM r""", extra="""
n AS (SELECT entity, period_start, unemployment_rate, row_number() OVER (PARTITION BY entity ORDER BY period_start) AS i FROM monthly),
r AS (SELECT a.entity, a.period_start, a.unemployment_rate,
  sum(b.unemployment_rate * CASE WHEN b.i = 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, a.i - b.i)) AS s
  FROM n a JOIN n b ON a.entity = b.entity AND b.i <= a.i GROUP BY 1, 2, 3)"""),
    "latest_against_back": facts("""SELECT *, round(latest - reference, 4) AS delta FROM (
SELECT entity, indicator, max("value") FILTER (k = 1) AS latest,
  coalesce(max("value") FILTER (k = 13), arg_min("value", period_start)) AS reference
FROM (SELECT *, row_number() OVER (PARTITION BY entity, indicator ORDER BY period_start DESC) AS k FROM (
  UNPIVOT (SELECT entity, period_start, unemployment_rate, hicp, total_credit FROM monthly) ON unemployment_rate, hicp, total_credit
  INTO NAME indicator VALUE "value")) GROUP BY 1, 2)"""),
    "nation_ranks": facts("""SELECT entity, year, 'unemployment_rate' AS indicator, u AS "value",
  CAST(row_number() OVER (PARTITION BY year ORDER BY u, entity) AS INTEGER) AS rank FROM y
UNION ALL SELECT entity, year, 'total_credit', c, CAST(row_number() OVER (PARTITION BY year ORDER BY c DESC, entity) AS INTEGER) FROM y""",
        extra="y AS (SELECT entity, year, round(avg(unemployment_rate), 4) AS u, round(sum(total_credit), 2) AS c FROM monthly GROUP BY 1, 2)"),
    "customer_ranks": f"""SELECT *, rank() OVER (PARTITION BY year ORDER BY "value" DESC) AS rank FROM (
SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, sum({_P}) / 100.0::DOUBLE AS "value" FROM orders GROUP BY 1, 2)""",
    "indicator_pairs": facts(PAIRS, extra=f"y AS (SELECT entity, year, {', '.join(f'round(avg({c}), 4) AS {c}' for c in NAMES)} FROM monthly GROUP BY 1, 2)"),
    "stacked_indicators": facts("""SELECT *, CAST(CASE source_name WHEN 'INE' THEN 1 ELSE 4 END AS INTEGER) AS source_key FROM (
SELECT entity, date_key, 'unemployment_rate' AS indicator, unemployment_rate AS "value", 'Eurostat' AS source_name FROM monthly
UNION ALL SELECT entity, date_key, 'hicp', hicp, 'Eurostat' FROM monthly
UNION ALL SELECT entity, date_key, 'real_gdp', real_gdp, 'INE' FROM quarterly)""", "monthly", "quarterly"),
    "grain_roll_up": facts("""SELECT entity, year || '-Q' || quarter(period_start) AS quarter_key, round(sum(total_credit), 2) AS credit_sum,
  round(avg(unemployment_rate), 4) AS rate_avg, arg_max(euribor_3m, CASE WHEN euribor_3m IS NOT NULL THEN period_start END) AS euribor_last,
  count(*) AS months FROM monthly GROUP BY 1, 2"""),
}
