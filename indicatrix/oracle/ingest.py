"""DuckDB forms of the ingest queries: what the tidy rows must be, straight from the tables."""

from __future__ import annotations

from indicatrix.oracle.base import CENTS, facts
from indicatrix.registry import PILLARS

_P = CENTS.format("o_totalprice")
FULL_DATE = "CAST(last_day(period_start + INTERVAL 2 MONTH) AS DATE)"


def cell(c: str) -> str:
    return f"CASE WHEN month <> 6 THEN {c} END AS {c}"


def extracted(pillar: str) -> str:
    spec = PILLARS[pillar]
    lead, source = spec.columns[0], "quarterly" if spec.grain == "quarter" else "monthly"
    return f"SELECT '{pillar}' AS pillar, count(*) AS rows, count({lead}) AS known, round(sum({lead}), 2) AS total, 'pass' AS schema_status, 'loaded' AS read_status FROM {source}"


SQL = {
    "extracted_pillars": facts(" UNION ALL ".join(extracted(p) for p in PILLARS), "monthly", "quarterly"),
    "page_digests": "SELECT page_id, sha256(html) AS checksum, CAST(strlen(html) AS BIGINT) AS size FROM pages",
    "upserted_partitions": f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n,
  CAST(sum({_P} + CASE WHEN hit THEN 100 ELSE 0 END) AS BIGINT) AS cents FROM (SELECT *, o_orderpriority = '1-URGENT' AND year(o_orderdate) IN (1996, 1998) AS hit FROM orders) GROUP BY 1, 2""",
    "positional_payload": facts("""SELECT entity, date_key AS period, npl_ratio AS "value" FROM monthly WHERE npl_ratio IS NOT NULL"""),
    "parallel_payload": facts("""SELECT entity, date_key AS period, npl_ratio AS "value", period_start FROM monthly WHERE npl_ratio IS NOT NULL"""),
    "observation_lines": f"""SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, CAST(sum({_P}) AS BIGINT) AS cents FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
    "event_props": """SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS low, max(k) AS high FROM (SELECT event_type,
  CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events) GROUP BY 1""",
    "upserted_facts": facts("""SELECT entity, date_key, unemployment_rate + CASE WHEN date_key >= '2001-04' THEN 2 WHEN date_key >= '2001-01' THEN 1 ELSE 0 END AS unemployment_rate FROM monthly
UNION ALL SELECT entity, '2002-01', unemployment_rate FROM monthly WHERE date_key = '2001-01'"""),
    "upserted_orders": f"""SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, CAST(sum({_P}) AS BIGINT) AS cents FROM orders GROUP BY 1""",
    "loaded_facts": facts(f"""SELECT entity, date_key, CAST(CASE WHEN month <> 7 THEN 4 END AS INTEGER) AS source_key, {cell('hicp')}, {cell('cpi_estimated')}, {cell('core_inflation')},
  false AS is_provisional FROM monthly"""),
    "explorer_rows": facts(f"""SELECT entity, date_key, {FULL_DATE} AS full_date, year, quarter, total_debt, debt_to_gdp_ratio, round(budget_deficit, 2) AS budget_deficit FROM quarterly""", "quarterly"),
}
