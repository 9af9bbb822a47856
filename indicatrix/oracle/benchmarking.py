"""DuckDB forms of the peer benchmark queries."""

from __future__ import annotations

from indicatrix.oracle.base import facts
from indicatrix.plans.benchmarking import FOCAL

BP = """bp AS (SELECT entity, year, indicator, "value", indicator <> 'gdp_growth' AS lower_is_better FROM (UNPIVOT (
  SELECT entity, year, round(g, 4) AS gdp_growth, round(u, 4) AS unemployment, round(h, 4) AS inflation, round(d, 4) AS debt_to_gdp, round(y, 4) AS interest_rate_10y
  FROM (SELECT entity, year, avg(gdp_growth_yoy) AS g, avg(debt_to_gdp_ratio) AS d FROM quarterly GROUP BY 1, 2)
  FULL JOIN (SELECT entity, year, avg(unemployment_rate) AS u, avg(hicp) AS h, avg(portugal_10y_bond_yield) AS y FROM monthly GROUP BY 1, 2) USING (entity, year))
  ON gdp_growth, unemployment, inflation, debt_to_gdp, interest_rate_10y INTO NAME indicator VALUE "value")),
gp AS (SELECT *, avg("value") OVER p AS average, "value" - avg("value") OVER p AS gap, count(*) OVER p AS n_peers,
  CAST(row_number() OVER (PARTITION BY indicator, year ORDER BY CASE WHEN lower_is_better THEN "value" ELSE -"value" END, entity) AS INTEGER) AS rank,
  row_number() OVER (PARTITION BY entity, indicator ORDER BY year DESC) AS k FROM bp WINDOW p AS (PARTITION BY indicator, year)),
cv AS (SELECT entity, indicator, count(*) AS n_years, CASE WHEN count(*) < 2 THEN 'insufficient_data' WHEN regr_slope(abs(gap), -k) > 0 THEN 'diverging'
    ELSE 'converging' END AS trend, CASE WHEN count(*) < 2 THEN 0 ELSE round(regr_slope(abs(gap), -k), 3) END AS convergence_rate FROM gp WHERE k <= 5 GROUP BY 1, 2),
pc AS (SELECT gp.entity, gp.indicator, year, round("value", 4) AS "value", rank, n_peers, round(gap, 2) AS gap_to_average, trend, convergence_rate
  FROM gp LEFT JOIN cv ON gp.entity = cv.entity AND gp.indicator = cv.indicator WHERE year = (SELECT max(year) FROM bp))"""

# the same queries over customers: the panel differs, the steps after it do not
CP = "bp AS (SELECT *, indicator = 'low_share' AS lower_is_better FROM (UNPIVOT (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS orders, " \
     "round(avg(CASE WHEN o_orderpriority = '5-LOW' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS low_share FROM orders GROUP BY 1, 2) ON orders, low_share INTO NAME indicator VALUE \"value\")),\ngp AS " \
     + BP.split("gp AS ", 1)[1].replace('entity) AS INTEGER) AS rank', 'entity) AS BIGINT) AS rank')

SQL = {name: facts(sql, "monthly", "quarterly", extra=BP) for name, sql in {
    "benchmark_panel": "SELECT * FROM bp",
    "peer_comparison": "SELECT * FROM pc",
    "convergence_trends": "SELECT * FROM cv",
    "convergence_overview": """SELECT entity, count(*) FILTER (trend = 'converging') AS converging_count, count(*) FILTER (trend <> 'converging') AS diverging_count,
  CASE WHEN count(*) FILTER (trend = 'converging') >= 3 THEN 'broadly converging' WHEN count(*) FILTER (trend = 'converging') >= 2 THEN 'mixed signals'
    ELSE 'broadly diverging' END AS overall_assessment FROM pc GROUP BY 1""",
    "peer_pivot": "SELECT indicator, " + ", ".join(f"""round(max("value") FILTER (entity = '{e}'), 4) AS {e}""" for e in FOCAL)
        + """, round(avg("value"), 4) AS AVG FROM bp WHERE year = (SELECT max(year) FROM bp) GROUP BY 1""",
    "rank_history": f"""SELECT entity, indicator, year, round("value", 4) AS "value", rank, n_peers AS total_peers FROM gp WHERE entity = '{FOCAL[0]}'""",
    "benchmark_findings": """SELECT entity, first(indicator ORDER BY rank, indicator) AS best_indicator, min(rank) AS best_rank,
  first(indicator ORDER BY rank DESC, indicator) AS worst_indicator, max(rank) AS worst_rank,
  first(indicator ORDER BY abs(gap_to_average) DESC, indicator DESC) AS largest_gap_indicator, max(abs(gap_to_average)) AS largest_gap,
  count(*) FILTER (trend = 'converging' AND abs(convergence_rate) > 0.5) AS n_strong_convergence,
  CASE WHEN first(gap_to_average ORDER BY abs(gap_to_average) DESC, indicator DESC) > 0 THEN 'above' ELSE 'below' END AS gap_direction FROM pc GROUP BY 1""",
    "peer_radar": """SELECT entity, indicator, round(CASE WHEN hi = lo THEN 50.0::DOUBLE WHEN lower_is_better THEN (1.0::DOUBLE - ("value" - lo) / (hi - lo)) * 100.0::DOUBLE
  ELSE ("value" - lo) / (hi - lo) * 100.0::DOUBLE END, 1) AS score FROM (SELECT *, min("value") OVER p AS lo, max("value") OVER p AS hi FROM bp
  WHERE year = (SELECT max(year) FROM bp) WINDOW p AS (PARTITION BY indicator))""",
}.items()}
SQL |= {"customer_comparison": f"WITH {CP} SELECT * FROM pc",
        "customer_rank_history": f"""WITH {CP} SELECT entity, indicator, year, round("value", 4) AS "value", rank, n_peers AS total_peers FROM gp"""}
