"""DuckDB forms of the statistical queries. Tail probabilities are integrated numerically (Simpson, 2000 intervals)."""

from __future__ import annotations

from indicatrix.oracle.base import facts, period_case
from indicatrix.plans.economy import PHILLIPS_PERIODS
from indicatrix.plans.statistics import MATRIX, MONTHLY_PRIMARY, PRIMARY

B = "ecb_main_refinancing_rate"


def f_p(f: str, d1: str, d2: str) -> str:
    """P(F > f): 2 / B(d1/2, d2/2) times the integral of cos^(d1-1)(s) sin^(d2-1)(s) from 0 to pi/2 - atan(sqrt(d1 f / d2)).

    With few degrees of freedom the substitution s = u^6 keeps the integrand smooth at 0.
    """
    q = f"(CASE WHEN {d2} < 4 THEN 6 ELSE 1 END)"
    end = f"pow(greatest(pi() / 2 - atan(sqrt({d1} * ({f}) / ({d2}))), 0), 1.0::DOUBLE / {q})"
    step = f"({end} / 2000)"
    u = f"(i * {step})"
    term = (f"(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {q} * pow({u}, {q} - 1) * pow(sin(pow({u}, {q})), {d2} - 1) "
            f"* pow(greatest(cos(pow({u}, {q})), 0), {d1} - 1)")
    beta = f"exp(lgamma({d1} / 2.0) + lgamma(({d2}) / 2.0) - lgamma({d1} / 2.0 + ({d2}) / 2.0))"
    return f"(2 / {beta} * {step} / 3 * list_sum(list_transform(range(0, 2001), lambda i: {term})))"


def annual(extra: str = "") -> str:
    q = ", ".join(f"avg({c}) AS {c}" for c in ("real_gdp", "debt_to_gdp_ratio"))
    m = ", ".join(f"avg({c}) AS {c}" for c in MONTHLY_PRIMARY)
    text = f"""ap AS (SELECT entity, year, indicator, "value" FROM (UNPIVOT (SELECT * FROM
  (SELECT entity, year, {q} FROM quarterly GROUP BY 1, 2) FULL JOIN (SELECT entity, year, {m} FROM monthly GROUP BY 1, 2) USING (entity, year))
  ON {", ".join(PRIMARY)} INTO NAME indicator VALUE "value") WHERE "value" IS NOT NULL)"""
    return text + (", " + extra if extra else "")


MP = f"""mp AS (SELECT entity, period_start, year, indicator, "value" FROM (UNPIVOT (SELECT entity, period_start, year, {", ".join(MONTHLY_PRIMARY)}
  FROM monthly) ON {", ".join(MONTHLY_PRIMARY)} INTO NAME indicator VALUE "value") WHERE "value" IS NOT NULL)"""


def trend(source: str, order: str) -> str:
    return f"""SELECT entity, indicator, n, round(b, 6) AS slope, round(a, 4) AS intercept, round(r2, 4) AS r_squared,
  round(se, 6) AS std_err, round(p, 6) AS p_value, round(p, 6) < 0.05 AS significant FROM (
SELECT *, {f_p("b * b / NULLIF(se * se, 0)", "1", "n - 2")} AS p FROM (
SELECT entity, indicator, n, b, a, sxy * sxy / NULLIF(sxx * syy, 0) AS r2, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS se FROM (
SELECT entity, indicator, count(*) AS n, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy,
  regr_sxy(y, t) AS sxy FROM (SELECT *, "value" AS y, CAST(row_number() OVER (PARTITION BY entity, indicator ORDER BY {order}) - 1 AS DOUBLE) AS t
  FROM {source}) GROUP BY 1, 2 HAVING count(*) >= 3)))"""


def corr(keys: str, source: str, x: str, y: str, where: str = "true", min_n: int = 0) -> str:
    return f"""SELECT {keys}, n, round(r, 4) AS r, round(p, 6) AS p_value,
  CASE WHEN r IS NULL THEN 'insufficient data' WHEN abs(round(r, 4)) >= 0.7 THEN 'strong' WHEN abs(round(r, 4)) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
  round(p, 6) < 0.05 AS significant FROM (
  SELECT *, CASE WHEN n > 2 AND r IS NOT NULL THEN {f_p("r * r * (n - 2) / greatest(1 - r * r, 1e-18)", "1", "n - 2")} END AS p FROM (
  SELECT {keys}, n, CASE WHEN n >= 3 AND sxx > 1e-12 AND syy > 1e-12 THEN greatest(-1, least(1, sxy / sqrt(sxx * syy))) END AS r FROM (
  SELECT {keys}, CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy
  FROM {source} WHERE {where} GROUP BY ALL) WHERE n >= {min_n}))"""


PSTATS = f"""ps AS (SELECT entity, indicator, {period_case("year")} AS period, count(*) AS n, avg("value") AS mean, var_samp("value") AS var
  FROM {{0}} GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
ANOVA = f"""SELECT entity, indicator, k AS n_periods, round(f, 4) AS f_statistic, round(p, 6) AS p_value, round(p, 6) < 0.05 AS significant FROM (
  SELECT *, {f_p("f", "(k - 1)", "total - k")} AS p FROM (
  SELECT entity, indicator, k, total, (between_ / (k - 1)) / NULLIF(within_ / (total - k), 0) AS f FROM (
  SELECT entity, indicator, count(*) AS k, CAST(sum(n) AS BIGINT) AS total, sum(n * (mean - g) * (mean - g)) AS between_, sum((n - 1) * var) AS within_
  FROM (SELECT *, sum(n * mean) OVER e / sum(n) OVER e AS g FROM ps WINDOW e AS (PARTITION BY entity, indicator)) GROUP BY 1, 2 HAVING count(*) >= 2)))"""
_RSS = "greatest(regr_syy({y}, t) - pow(regr_sxy({y}, t), 2) / NULLIF(regr_sxx({y}, t), 0), 0)"


def chow(label: str, at: int) -> str:
    left, right = f"CASE WHEN year < {at} THEN y END", f"CASE WHEN year >= {at} THEN y END"
    return f"""SELECT entity, indicator, '{label}' AS break_label, count(*) AS n, count({left}) AS nl, count({right}) AS nr,
  {_RSS.format(y="y")} AS pooled, {_RSS.format(y=left)} + {_RSS.format(y=right)} AS split FROM att GROUP BY 1, 2"""


AT = """att AS (SELECT *, "value" AS y, CAST(row_number() OVER (PARTITION BY entity, indicator ORDER BY year) - 1 AS DOUBLE) AS t FROM ap)"""
CHOW = f"""SELECT entity, indicator, break_label, n, round(f, 4) AS f_statistic, round(p, 6) AS p_value, round(p, 6) < 0.05 AS significant,
  round(CASE WHEN f IS NOT NULL THEN pooled END, 4) AS rss_full, round(CASE WHEN f IS NOT NULL THEN split END, 4) AS rss_split FROM (
  SELECT *, pow(1 + 2 * f / (n - 4), -(n - 4) / 2.0::DOUBLE) AS p FROM (
  SELECT *, CASE WHEN nl >= 3 AND nr >= 3 AND n > 4 AND split > 0 THEN (pooled - split) / 2 / (split / (n - 4)) END AS f
  FROM ({chow("early_1998", 1998)} UNION ALL {chow("late_2001", 2001)})))"""
LL = f"""SELECT entity, CAST(lag AS INTEGER) AS lag, n AS n_obs, round(r, 4) AS correlation, round(p, 6) AS p_value, round(least(p * L, 1), 6) AS p_value_bonferroni,
  p < 0.05 / L AS significant, coalesce(lag = first_value(CASE WHEN p < 0.05 / L THEN lag END) OVER (PARTITION BY entity
    ORDER BY CASE WHEN p < 0.05 / L THEN abs(r) END DESC NULLS LAST, lag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), false) AS is_best FROM (
  SELECT *, {f_p("r * r * (n - 2) / greatest(1 - r * r, 1e-18)", "1", "n - 2")} AS p FROM (
  SELECT b.entity, k.lag, count(*) AS n, corr(a.x, b.y) AS r, CASE WHEN any_value(b.na) < 17 THEN greatest(1, any_value(b.na) - 5) ELSE 12 END AS L
  FROM (SELECT unnest(range(1, 13)) AS lag) k CROSS JOIN s b JOIN s a ON a.entity = b.entity AND a.i = b.i - k.lag GROUP BY 1, 2
  HAVING count(*) >= 4) WHERE lag <= L)"""
LLS = f"""s AS (SELECT entity, {B} AS x, total_credit AS y, row_number() OVER (PARTITION BY entity ORDER BY period_start) AS i,
  count(*) OVER (PARTITION BY entity) AS na FROM monthly WHERE {B} IS NOT NULL AND total_credit IS NOT NULL)"""
_PH = ", ".join(f"('{n}', {a}, {b})" for n, a, b in [("overall", 0, 9999), *PHILLIPS_PERIODS])
PHILLIPS = corr("entity, period", f"(SELECT * FROM monthly JOIN (VALUES {_PH}) p(period, a, b) ON year BETWEEN a AND b)", "unemployment_rate", "hicp", min_n=3)


def transmission() -> str:
    def one(effect: str) -> str:
        source = f"""(SELECT m.entity, CAST(k.lag AS INTEGER) AS lag, '{effect}' AS effect, c.{B} AS x, m.{effect} AS y FROM monthly m
  CROSS JOIN (VALUES (0), (3), (6), (12)) k(lag) JOIN monthly c ON c.entity = m.entity AND c.period_start = m.period_start - to_months(k.lag))"""
        return corr("entity, lag, effect", source, "x", "y")
    return one("total_credit") + " UNION ALL " + one("hicp")


DEBT = ", ".join(f"({c} - lag({c}) OVER w) / NULLIF(lag({c}) OVER w, 0) AS g_{c}" for c in ("total_debt", "nominal_gdp"))
DG = f"""dg AS (SELECT entity, 'levels' AS method, total_debt AS x, nominal_gdp AS y FROM quarterly
  UNION ALL SELECT entity, 'growth_rates', g_total_debt, g_nominal_gdp FROM (SELECT *, {DEBT} FROM quarterly WINDOW w AS (PARTITION BY entity ORDER BY period_start)))"""
DEBT_CORR = corr("entity, method", "dg", "x", "y")
PAIRS = [(a, b) for i, a in enumerate(MATRIX) for b in MATRIX[i + 1:]]


def matrix(source: str) -> str:
    stacked = " UNION ALL ".join(f"SELECT entity, '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM {source}" for a, b in PAIRS)
    return corr("entity, a, b", f"({stacked})", "x", "y")


DIFFS = "dm AS (SELECT entity, " + ", ".join(
    f"{c} - lag({c}) OVER (PARTITION BY entity ORDER BY period_start) AS {c}" for c in MATRIX) + " FROM monthly)"


def redundant(parts: str, name: str) -> str:
    return f"""SELECT entity, 'total_credit' AS total, '{name}' AS parts, CAST(regr_count({parts}, total_credit) AS BIGINT) AS n, round(corr({parts}, total_credit), 6) AS r,
  abs(corr({parts}, total_credit)) > 0.999 AS is_redundant FROM monthly GROUP BY 1"""


def adf(source: str, order: str) -> str:
    """Unit-root statistics by eliminating one regressor after the other from the sums of products, the level last."""
    changes = ", ".join(f"CASE WHEN k >= {j} THEN z{j} - z{j + 1} ELSE 0 END" for j in range(1, 5))
    lags = ", ".join(f"lag(z, {j}) OVER w AS z{j}" for j in range(1, 6))
    steps = ""
    for p in range(1, 6):
        on = "{0}.entity = m.entity AND {0}.indicator = m.indicator AND {0}.i = {1} AND {0}.j = {2}"
        steps += f""", e{p} AS MATERIALIZED (SELECT m.entity, m.indicator, m.i, m.j, m.v - CASE WHEN q.v > 1e-10 * g.v THEN r.v * c.v / q.v ELSE 0 END AS v FROM e{p - 1} m
  JOIN e{p - 1} q ON {on.format("q", p, p)} JOIN e{p - 1} r ON {on.format("r", "m.i", p)} JOIN e{p - 1} c ON {on.format("c", p, "m.j")}
  JOIN e0 g ON {on.format("g", p, p)} WHERE m.i > {p} AND m.j > {p})"""
    used = " UNION ALL ".join(f"SELECT entity, indicator, v, {p} AS p FROM e{p - 1} WHERE i = {p} AND j = {p}" for p in range(1, 7))
    return f"""zz AS (SELECT entity, indicator, t, n, least(4, (n - 1) // 4) AS k, z, {lags} FROM (
  SELECT entity, indicator, row_number() OVER w - 1 AS t, count(*) OVER s AS n, ("value" - avg("value") OVER s) / coalesce(nullif(stddev_samp("value") OVER s, 0), 1) AS z
  FROM {source} WINDOW w AS (PARTITION BY entity, indicator ORDER BY {order}), s AS (PARTITION BY entity, indicator)) WINDOW w AS (PARTITION BY entity, indicator ORDER BY t)),
e0 AS MATERIALIZED (SELECT entity, indicator, i, j, sum(x[i] * x[j]) AS v FROM (SELECT entity, indicator, [1.0::DOUBLE, {changes}, z1, z - z1] AS x FROM zz WHERE t > k),
  (SELECT unnest(range(1, 8)) AS i), (SELECT unnest(range(1, 8)) AS j) GROUP BY ALL){steps},
us AS (SELECT u.entity, u.indicator, count(*) AS used FROM ({used}) u JOIN e0 ON e0.entity = u.entity AND e0.indicator = u.indicator AND i = p AND j = p WHERE u.v > 1e-10 * e0.v GROUP BY ALL),
fi AS (SELECT entity, indicator, max(v) FILTER (i = 6 AND j = 6) AS ll, max(v) FILTER (i = 6 AND j = 7) AS lt, max(v) FILTER (i = 7 AND j = 7) AS tt FROM e5 GROUP BY ALL),
pl AS (SELECT entity, indicator, any_value(n) AS n, any_value(k) AS k, regr_sxx(z - z1, z1) AS sxx, regr_syy(z - z1, z1) AS syy, regr_sxy(z - z1, z1) AS sxy, regr_count(z - z1, z1) AS m FROM zz GROUP BY ALL),
st AS (SELECT entity, indicator, CASE WHEN n < 8 THEN n WHEN used = k + 2 THEN n - 1 - k ELSE n - 1 END AS n_obs, CASE WHEN n < 8 THEN NULL
  WHEN used = k + 2 THEN coalesce(lt / ll / nullif(sqrt(greatest(tt - lt * lt / ll, 0) / greatest(n - 2 * k - 3, 1) / ll), 0), 0)
  WHEN sxx > 1e-10 * m THEN coalesce(sxy / sxx / nullif(sqrt(greatest(syy - sxy * sxy / sxx, 0) / greatest(m - 2, 1) / sxx), 0), 0) END AS stat FROM pl LEFT JOIN us USING (entity, indicator) LEFT JOIN fi USING (entity, indicator)),
roots AS (SELECT *, stat < CASE WHEN n_obs < 50 THEN -2.93 ELSE -2.86 END AS is_stationary FROM st)"""


ROOTS = """SELECT entity, indicator, n_obs, round(stat, 4) AS adf_statistic, round(CASE WHEN stat < CASE WHEN n_obs < 50 THEN -3.58 ELSE -3.43 END THEN 0.005 WHEN is_stationary THEN 0.03
  WHEN stat < CASE WHEN n_obs < 50 THEN -2.60 ELSE -2.57 END THEN 0.07 WHEN stat IS NOT NULL THEN 0.15 + 0.05 * least(greatest(stat + 2.57, 0), 5) END, 4) AS p_value, is_stationary FROM roots"""
MIXED = f"""xp AS (SELECT entity, period_start, indicator, "value" FROM (UNPIVOT (SELECT entity, period_start, {", ".join(MATRIX)} FROM monthly) ON {", ".join(MATRIX)} INTO NAME indicator VALUE "value")),
{adf("xp", "period_start")},
md AS (SELECT entity, {", ".join(f"CASE WHEN list_contains(d, '{c}') THEN {c} - lag({c}) OVER (PARTITION BY entity ORDER BY period_start) ELSE {c} END AS {c}" for c in MATRIX)}
  FROM monthly LEFT JOIN (SELECT entity, list(indicator) AS d FROM roots WHERE NOT is_stationary GROUP BY 1) USING (entity)),
rt AS (SELECT entity FROM ({redundant("(credit_nfc + credit_households)", "two")}) WHERE is_redundant AND n >= 5)"""
KEPT = f"""SELECT * FROM ({matrix("md")}) WHERE NOT (entity IN (SELECT entity FROM rt) AND (a = 'total_credit' OR b = 'total_credit'))"""

BAND = f"""fit AS MATERIALIZED (SELECT entity, regr_count(hicp, unemployment_rate) AS n, regr_sxx(hicp, unemployment_rate) AS sxx,
  regr_syy(hicp, unemployment_rate) AS syy, regr_sxy(hicp, unemployment_rate) AS sxy, regr_slope(hicp, unemployment_rate) AS b,
  regr_intercept(hicp, unemployment_rate) AS a, avg(unemployment_rate) AS mx, min(unemployment_rate) AS lo, max(unemployment_rate) AS hi
  FROM monthly WHERE hicp IS NOT NULL GROUP BY 1),
cuts AS (WITH RECURSIVE r AS (SELECT DISTINCT n - 2 AS df, 0.0::DOUBLE AS low, 100.0::DOUBLE AS high, 0 AS turn FROM fit
  UNION ALL SELECT df, CASE WHEN p > 0.05 THEN middle ELSE low END, CASE WHEN p > 0.05 THEN high ELSE middle END, turn + 1 FROM (
    SELECT *, {f_p("middle * middle", "1", "df")} AS p FROM (SELECT *, (low + high) / 2 AS middle FROM r WHERE turn < 45)))
  SELECT df, (low + high) / 2 AS t FROM r WHERE turn = 45)"""
BAND_ROWS = """SELECT entity, CAST(i AS INTEGER) AS i, round(x, 4) AS x, round(a + b * x, 4) AS fitted, round(err, 4) AS std_err_fit, round(a + b * x - t * err, 4) AS band_low, round(a + b * x + t * err, 4) AS band_high
FROM (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) * sqrt(1.0::DOUBLE / n + (x - mx) * (x - mx) / sxx) AS err
  FROM (SELECT *, lo + (hi - lo) * i / 24 AS x FROM fit CROSS JOIN (SELECT unnest(range(0, 25)) AS i)) JOIN cuts ON df = n - 2)"""
DIVERGENCE = """SELECT entity, year, CASE WHEN d > 1 THEN 'rising' ELSE 'falling' END AS debt_direction,
  CASE WHEN o > 1 THEN 'rising' ELSE 'falling' END AS gdp_direction, round(d, 2) AS debt_change_pct, round(o, 2) AS gdp_change_pct
FROM (SELECT entity, year, (debt - lag(debt) OVER w) / NULLIF(lag(debt) OVER w, 0) * 100 AS d, (output - lag(output) OVER w) / NULLIF(lag(output) OVER w, 0) * 100 AS o
  FROM (SELECT entity, year, avg(total_debt) AS debt, avg(nominal_gdp) AS output FROM quarterly GROUP BY 1, 2) WINDOW w AS (PARTITION BY entity ORDER BY year))
WHERE (d > 1 AND o < -1) OR (d < -1 AND o > 1)"""

SQL = {
    "unit_roots": facts(ROOTS, extra=MP + ", " + adf("mp", "period_start")),
    "correlation_matrix": facts(KEPT, extra=MIXED),
    "trend_tests": facts(trend("ap", "year"), "monthly", "quarterly", extra=annual()),
    "trend_tests_monthly": facts(trend("mp", "period_start"), extra=MP),
    "period_anova": facts(ANOVA, extra=MP + ", " + PSTATS.format("mp")),
    "period_pairwise": facts(f"""SELECT entity, indicator, period_a, period_b, round(t, 4) AS t_statistic, round(p, 6) AS p_value,
  round(CASE WHEN p IS NOT NULL THEN least(p * m, 1) END, 6) AS p_value_bonferroni, p < 0.05 AS significant_nominal, p < 0.05 / m AS significant,
  round(CASE WHEN sqrt((va + vb) / 2) > 1e-12 THEN gap / sqrt((va + vb) / 2) ELSE 0 END, 3) AS cohens_d, round(gap, 4) AS mean_diff FROM (
  SELECT *, {f_p("t * t", "1", "df")} AS p FROM (SELECT a.entity, a.indicator, a.period AS period_a, b.period AS period_b, a.mean - b.mean AS gap,
    a.var AS va, b.var AS vb, (a.mean - b.mean) / NULLIF(sqrt(a.var / a.n + b.var / b.n), 0) AS t, a.k * (a.k - 1) / 2 AS m,
    pow(a.var / a.n + b.var / b.n, 2) / NULLIF(pow(a.var / a.n, 2) / (a.n - 1) + pow(b.var / b.n, 2) / (b.n - 1), 0) AS df
  FROM pk a JOIN pk b ON a.entity = b.entity AND a.indicator = b.indicator AND a.period < b.period))""",
        extra=MP + ", " + PSTATS.format("mp") + ", pk AS (SELECT *, count(*) OVER (PARTITION BY entity, indicator) AS k FROM ps)"),
    "structural_breaks": facts(CHOW, "monthly", "quarterly", extra=annual(AT)),
    "lead_lag_tests": facts(LL, extra=LLS),
    "phillips_curve": facts(PHILLIPS),
    "rate_transmission": facts(transmission()),
    "rate_transmission_best": facts("""SELECT entity, effect, arg_max(lag, s) AS optimal_lag, arg_max(r, s) AS optimal_r, arg_max(p_value, s) AS optimal_p_value
FROM (SELECT *, CASE WHEN p_value < 0.05 THEN abs(r) END AS s FROM tr) GROUP BY 1, 2""", extra=f"tr AS ({transmission()})"),
    "debt_gdp_correlation": facts(DEBT_CORR, "quarterly", extra=DG),
    "divergence_years": facts(DIVERGENCE, "quarterly"),
    "correlation_levels": facts(matrix("monthly")),
    "correlation_differences": facts(matrix("dm"), extra=DIFFS),
    "near_perfect_pairs": facts(f"SELECT entity, a, b, n, r, abs(r) > 0.95 AS is_suspicious FROM ({matrix('monthly')}) WHERE abs(r) > 0.5"),
    "redundant_totals": facts(redundant("(credit_nfc + credit_households)", "two") + " UNION ALL "
                              + redundant("(credit_nfc + credit_households + (total_credit - credit_nfc - credit_households))", "three")),
    "phillips_fit": facts(f"SELECT entity, i, x, fitted, std_err_fit FROM ({BAND_ROWS})", extra=BAND),
    "phillips_band": facts(BAND_ROWS, extra=BAND),
    "seasonal_parts": facts("""SELECT entity, indicator, period_start, round(y, 3) AS observed, round(trend, 3) AS trend, round(s - c, 3) AS seasonal,
  round(y - trend - (s - c), 3) AS residual FROM (
  SELECT *, avg(CASE WHEN t < 12 THEN s END) OVER (PARTITION BY entity, indicator) AS c FROM (
  SELECT *, avg(CASE WHEN m IS NOT NULL THEN y - m END) OVER (PARTITION BY entity, indicator, t % 12) AS s,
    coalesce(m, last_value(m IGNORE NULLS) OVER (PARTITION BY entity, indicator ORDER BY t ROWS UNBOUNDED PRECEDING),
      first_value(m IGNORE NULLS) OVER (PARTITION BY entity, indicator ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trend FROM (
  SELECT *, CASE WHEN t >= 6 AND t < n - 6 THEN (sum(y) OVER (PARTITION BY entity, indicator ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
    - (lag(y, 6) OVER w + lead(y, 6) OVER w) / 2) / 12 END AS m FROM (
  SELECT entity, indicator, period_start, "value" AS y, row_number() OVER (PARTITION BY entity, indicator ORDER BY period_start) - 1 AS t,
    count(*) OVER (PARTITION BY entity, indicator) AS n FROM mp) WHERE n >= 25 WINDOW w AS (PARTITION BY entity, indicator ORDER BY t))))""", extra=MP),
    "significance_report": facts(f"""SELECT t.entity, t.indicator, t.n, t.slope, t.p_value AS trend_p, a.f_statistic, a.p_value AS period_p,
  b.tested AS n_breaks_tested, b.hit AS n_breaks_significant, r.adf_statistic, r.p_value AS adf_p, r.is_stationary
FROM tt t LEFT JOIN an a USING (entity, indicator) LEFT JOIN (SELECT entity, indicator, count(f_statistic) AS tested,
  count(*) FILTER (significant) AS hit FROM br GROUP BY 1, 2) b USING (entity, indicator) LEFT JOIN ({ROOTS}) r USING (entity, indicator)""", "monthly", "quarterly",
        extra=annual(adf("ap", "year") + ", " + AT + ", " + PSTATS.format("ap") + f", tt AS ({trend('ap', 'year')}), an AS ({ANOVA}), br AS ({CHOW})")),
    "correlation_report": facts("""SELECT *, CASE WHEN abs(r) > 0.95 THEN 'suspiciously high' ELSE 'ok' END AS note FROM (
SELECT 'matrix' AS section, entity, a || '~' || b AS item, n, r, p_value FROM mx UNION ALL SELECT 'phillips', entity, period, n, r, p_value FROM ph
UNION ALL SELECT 'transmission', entity, effect || '@' || lag, n, r, p_value FROM tr UNION ALL SELECT 'debt_gdp', entity, method, n, r, p_value FROM dc
UNION ALL SELECT 'divergence_years', entity, 'total_debt~nominal_gdp', count(*), NULL, NULL FROM dy GROUP BY 2)""",
        "monthly", "quarterly", extra=f"{DG}, {MIXED}, mx AS ({KEPT}), dy AS ({DIVERGENCE}), ph AS ({PHILLIPS}), tr AS ({transmission()}), dc AS ({DEBT_CORR})"),
}
