"""DuckDB text of the cube and the facts, written independently of the Spark plans."""

from __future__ import annotations

from indicatrix.plans.economy import MEASURES, PERIODS

CENTS = "CAST(round({0} * 100) AS BIGINT)"
_G, _T, _D = (CENTS.format(c) for c in ("l_extendedprice", "l_tax", "l_discount"))

LINES = f"""
li AS (
  SELECT l_orderkey AS k, count(*) AS n_lines, sum({_G}) AS gross_c, sum({_G} * (100 - {_D})) AS net_e4,
    sum(CASE WHEN l_returnflag = 'N' THEN {_G} ELSE 0 END) AS gross_n_c,
    sum(CASE WHEN l_returnflag = 'A' THEN {_G} ELSE 0 END) AS gross_a_c,
    sum(CASE WHEN l_quantity >= 48 THEN {_G} ELSE 0 END) AS gross_big_c,
    sum({_D}) AS disc_p, sum({_T}) AS tax_p,
    sum(CASE WHEN l_linenumber <= 2 THEN {_T} ELSE 0 END) AS tax_short_p, count(*) FILTER (l_linenumber <= 2) AS n_short,
    sum(CASE WHEN l_linenumber <= 4 THEN {_T} ELSE 0 END) AS tax_mid_p, count(*) FILTER (l_linenumber <= 4) AS n_mid,
    sum(CASE WHEN l_returnflag <> 'R' THEN {_T} ELSE 0 END) AS tax_core_p, count(*) FILTER (l_returnflag <> 'R') AS n_core,
    sum(CAST(l_quantity AS BIGINT)) AS qty
  FROM lineitem GROUP BY l_orderkey
)"""

_P = CENTS.format("o_totalprice")


def _cube(grain: str, entity: str, source: str) -> str:
    return f"""
  SELECT {entity} AS entity, CAST(date_trunc('{grain}', o_orderdate) AS DATE) AS period_start,
    count(*) AS n_orders, sum({_P}) AS price_c,
    sum(CASE WHEN o_orderstatus = 'O' THEN {_P} ELSE 0 END) AS price_open_c,
    count(*) FILTER (o_orderpriority = '5-LOW') AS n_low,
    count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS n_unspecified,
    count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') AS n_low_filled,
    count(*) FILTER (o_orderstatus = 'P') AS n_pending,
    {", ".join(f"sum({m}) AS {m}" for m in MEASURES[7:])}
  FROM {source} LEFT JOIN li ON o_orderkey = k
  GROUP BY 1, 2"""


SOURCES = {
    "nation": ("n_name", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "region": ("r_name", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
                         "JOIN region ON n_regionkey = r_regionkey"),
    "segment": ("c_mktsegment", "orders JOIN customer ON o_custkey = c_custkey"),
    "customer": ("o_custkey", "orders"),
}

MONTHLY_COLUMNS = """
    100.0::DOUBLE * n_low / n_orders AS unemployment_rate,
    100.0::DOUBLE * (n_low + n_unspecified) / n_orders AS youth_unemployment_rate,
    100.0::DOUBLE * n_low_filled / n_orders AS long_term_unemployment_rate,
    100.0::DOUBLE * (n_orders - n_pending) / n_orders AS labour_force_participation_rate,
    gross_c / 100.0::DOUBLE AS total_credit, gross_n_c / 100.0::DOUBLE AS credit_nfc,
    gross_a_c / 100.0::DOUBLE AS credit_households,
    100.0::DOUBLE * gross_big_c / NULLIF(gross_c, 0) AS npl_ratio,
    4.0::DOUBLE * (disc_p::DOUBLE / n_lines) - 18.0::DOUBLE AS ecb_main_refinancing_rate,
    tax_short_p::DOUBLE / NULLIF(n_short, 0) AS euribor_3m, tax_mid_p::DOUBLE / NULLIF(n_mid, 0) AS euribor_6m,
    tax_p::DOUBLE / n_lines AS euribor_12m, qty::DOUBLE / (n_lines * 5) AS portugal_10y_bond_yield,
    3.0::DOUBLE * (tax_p::DOUBLE / n_lines) - 10.0::DOUBLE AS hicp,
    3.0::DOUBLE * (tax_mid_p::DOUBLE / NULLIF(n_mid, 0)) - 10.0::DOUBLE AS cpi_estimated,
    3.0::DOUBLE * (tax_core_p::DOUBLE / NULLIF(n_core, 0)) - 10.0::DOUBLE AS core_inflation"""

_REAL = "(net_e4 / 10000.0::DOUBLE)"
_BALANCE = "(20.0::DOUBLE * (gross_n_c - (gross_c - gross_n_c - gross_a_c)) / NULLIF(gross_c, 0))"
QUARTERLY_COLUMNS = f"""
    gross_c / 100.0::DOUBLE AS nominal_gdp, {_REAL} AS real_gdp,
    ({_REAL} - lag({_REAL}, 4) OVER w) / NULLIF(lag({_REAL}, 4) OVER w, 0) * 100.0::DOUBLE AS gdp_growth_yoy,
    ({_REAL} - lag({_REAL}, 1) OVER w) / NULLIF(lag({_REAL}, 1) OVER w, 0) * 100.0::DOUBLE AS gdp_growth_qoq,
    {_REAL} / n_orders AS gdp_per_capita,
    price_c / 100.0::DOUBLE AS total_debt, 100.0::DOUBLE * price_c / NULLIF(gross_c, 0) AS debt_to_gdp_ratio,
    {_BALANCE} AS budget_deficit,
    CASE WHEN count({_BALANCE}) OVER (PARTITION BY entity ORDER BY period_start ROWS 3 PRECEDING) >= 4
      THEN avg({_BALANCE}) OVER (PARTITION BY entity ORDER BY period_start ROWS 3 PRECEDING) END AS budget_deficit_annual,
    100.0::DOUBLE * price_open_c / NULLIF(price_c, 0) AS external_debt_share_estimated"""


def facts(sql: str, *names: str, entity: str = "nation", extra: str = "") -> str:
    """Put the CTEs the query needs (``monthly``, ``quarterly``, ``cube_m``, ``cube_q``) in front of ``sql``."""
    label, source = SOURCES[entity]
    parts = [LINES]
    wanted = set(names) or {"monthly"}
    if wanted & {"monthly", "cube_m"}:
        parts.append(f"cube_m AS ({_cube('month', label, source)})")
    if wanted & {"quarterly", "cube_q"}:
        parts.append(f"cube_q AS ({_cube('quarter', label, source)})")
    if "monthly" in wanted:
        parts.append(f"""monthly AS (SELECT entity, period_start, strftime(period_start, '%Y-%m') AS date_key,
    CAST(year(period_start) AS INTEGER) AS year, CAST(month(period_start) AS INTEGER) AS month, {MONTHLY_COLUMNS} FROM cube_m)""")
    if "quarterly" in wanted:
        parts.append(f"""quarterly AS (SELECT entity, period_start,
    year(period_start) || '-Q' || quarter(period_start) AS date_key,
    CAST(year(period_start) AS INTEGER) AS year, CAST(quarter(period_start) AS INTEGER) AS quarter, {QUARTERLY_COLUMNS}
    FROM cube_q WINDOW w AS (PARTITION BY entity ORDER BY period_start))""")
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + sql


def period_case(year: str, prefix: bool = True) -> str:
    whens = " ".join(f"WHEN {year} BETWEEN {a} AND {b} THEN '{n if prefix else n.split('. ')[-1]}'" for n, a, b in PERIODS)
    return f"CASE {whens} END"


def r(expr: str, digits: int = 2) -> str:
    return f"round({expr}, {digits})"


def half_up(sql: str) -> str:
    """Spell every two-argument ``round(x, n)`` as decimal half-up rounding; DuckDB rounds doubles in binary."""
    out, i = [], 0
    while True:
        start = sql.find("round(", i)
        if start < 0:
            return "".join(out) + sql[i:]
        depth, j, comma = 1, start + 6, None
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = j
            j += 1
        if comma is None:
            out.append(sql[i:start + 6])
            i = start + 6
            continue
        inner, digits = half_up(sql[start + 6:comma]), sql[comma + 1:j - 1].strip()
        out.append(sql[i:start] + f"CAST(round(CAST({inner} AS DECIMAL(30, 6)), {digits}) AS DOUBLE)")
        i = j
