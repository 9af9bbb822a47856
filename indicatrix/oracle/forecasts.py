"""DuckDB forms of the forecasts and backtests."""

from __future__ import annotations

from indicatrix.oracle.base import facts
from indicatrix.plans.forecasts import REVERTING

BANDS = ["forecast", "lower_68", "upper_68", "lower_95", "upper_95"]


def panel(name: str, source: str, columns: list[str], last: int | None = None) -> str:
    cut = f"QUALIFY row_number() OVER (PARTITION BY entity, indicator ORDER BY period_start DESC) <= {last}" if last else ""
    return f"""{name} AS (SELECT *, CAST(row_number() OVER w - 1 AS DOUBLE) AS t, lag(v) OVER w AS before, count(*) OVER (PARTITION BY entity, indicator) AS n FROM (
  SELECT entity, indicator, period_start, v FROM (UNPIVOT (SELECT entity, period_start, {", ".join(columns)} FROM {source}) ON {", ".join(columns)}
  INTO NAME indicator VALUE v) {cut}) WINDOW w AS (PARTITION BY entity, indicator ORDER BY period_start))"""


def bands(source: str, horizon: int, unit: str, digits: int, log: bool = False, extra: str = "") -> str:
    """``source`` has entity, indicator, last_period, h, c, w."""
    f = "exp({0})" if log else "{0}"
    parts = ", ".join(f"round({f.format(e)}, {digits}) AS {n}" for n, e in zip(BANDS, ["c", "c - w", "c + w", "c - 1.96 * w", "c + 1.96 * w"]))
    return f"""SELECT entity, indicator, h, CAST(last_period + to_months(CAST(h AS INTEGER) * {3 if unit == 'quarter' else 1}) AS DATE) AS period_start, {parts}{extra} FROM ({source})"""


def line(p: str, horizon: int, y: str = "v", log: bool = False) -> str:
    sd = "sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2))"
    width = f"greatest({sd}, 1e-10)" if log else f"{sd} * sqrt(1 + h / CAST(n AS DOUBLE))"
    return f"""SELECT *, a + b * (n - 1 + h) AS c, {width} AS w FROM (SELECT entity, indicator, count(*) AS n, regr_intercept({y}, t) AS a, regr_slope({y}, t) AS b,
  regr_sxx({y}, t) AS sxx, regr_syy({y}, t) AS syy, regr_sxy({y}, t) AS sxy, max(period_start) AS last_period FROM {p} GROUP BY 1, 2)
  CROSS JOIN (SELECT CAST(unnest(range(1, {horizon + 1})) AS INTEGER) AS h)"""


def revert(p: str, horizon: int, target: str = "mean") -> str:
    return f"""SELECT *, g + (last - g) * pow(1 - k, h) AS c, sqrt(s * s / (2 * k) * (1 - exp(-2 * k * h))) AS w FROM (
  SELECT *, {target} AS g, sqrt(greatest(syy + 2 * k * sxy + k * k * sxx, 0) / (m - 1)) AS s FROM (SELECT *, CASE WHEN sxx / m <= 1e-12 THEN 0.05 ELSE greatest(-b, 0.001) END AS k FROM (
  SELECT entity, indicator, CAST(regr_count(v - before, before) AS BIGINT) AS m, regr_slope(v - before, before) AS b, regr_sxx(v - before, before) AS sxx,
    regr_syy(v - before, before) AS syy, regr_sxy(v - before, before) AS sxy, avg(v) AS mean, arg_max(v, period_start) AS last, max(period_start) AS last_period
  FROM {p} GROUP BY 1, 2))) CROSS JOIN (SELECT CAST(unnest(range(1, {horizon + 1})) AS INTEGER) AS h)"""


LOG = "ln(greatest(v, 1e-6))"


def backtest(p: str, model: str, steps: int, origin: str) -> str:
    """Refit at every origin on the rows before it: a self-join, unlike the running aggregates it checks."""
    y = LOG if model == "log_linear" else "b.v"
    y = y.replace("(v", "(b.v")
    if model == "mean_reversion":
        fit = "avg(b.v) AS mean, arg_max(b.v, b.t) AS last, CASE WHEN regr_sxx(b.v - b.before, b.before) / regr_count(b.v - b.before, b.before) <= 1e-12 THEN 0.05 ELSE greatest(-regr_slope(b.v - b.before, b.before), 0.001) END AS k"
        predict = "f.mean + (f.last - f.mean) * pow(1 - f.k, h)"
    else:
        fit = f"regr_intercept({y}, b.t) AS a, regr_slope({y}, b.t) AS s"
        predict = "f.a + f.s * (f.o - 1 + h)" if model == "linear" else "exp(f.a + f.s * (f.o - 1 + h))"
    return f"""SELECT f.entity, f.indicator, '{model}' AS model, CAST(f.o AS INTEGER) AS origin, h, x.v AS actual, {predict} AS predicted
  FROM (SELECT o.entity, o.indicator, o.t + 1 AS o, {fit} FROM {p} o JOIN {p} b ON b.entity = o.entity AND b.indicator = o.indicator AND b.t <= o.t
    WHERE {origin} AND o.t + {steps} < o.n GROUP BY 1, 2, 3) f CROSS JOIN (SELECT CAST(unnest(range(1, {steps + 1})) AS INTEGER) AS h)
  JOIN {p} x ON x.entity = f.entity AND x.indicator = f.indicator AND x.t = f.o - 1 + h"""


def scored(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(avg(abs(actual - predicted)), 4) AS mae, round(sqrt(avg(pow(actual - predicted, 2))), 4) AS rmse,
  round(avg(abs((actual - predicted) / NULLIF(actual, 0))) * 100.0::DOUBLE, 2) AS mape, round(avg(CASE WHEN da IS NOT NULL THEN CASE WHEN (da >= 0) = (dp >= 0) THEN 100.0::DOUBLE ELSE 0 END END), 1)
  AS directional_accuracy_pct FROM (SELECT *, actual - lag(actual) OVER w AS da, predicted - lag(predicted) OVER w AS dp FROM ({source})
  WINDOW w AS (PARTITION BY entity, indicator, origin ORDER BY h)) GROUP BY {by}"""


EXPAND = "o.t + 1 >= {0} AND CAST(o.t + 1 AS INTEGER) % {1} = {0} % {1}"
SPLITS = "(o.n - o.t - 1) IN (12, 24, 36) AND o.t + 1 >= 12"


def weights(p: str, models: list[str]) -> str:
    stacked = " UNION ALL ".join(backtest(p, m, 12, SPLITS) for m in models)
    return f"""SELECT *, CASE WHEN sum(CASE WHEN mae > 0 THEN 1 / mae END) OVER e IS NULL THEN 1.0::DOUBLE / count(*) OVER e
  ELSE coalesce(CASE WHEN mae > 0 THEN 1 / mae END, 0) / sum(CASE WHEN mae > 0 THEN 1 / mae END) OVER e END AS weight FROM (
  SELECT entity, indicator, model, avg(e) AS mae FROM (SELECT entity, indicator, model, origin, avg(abs(actual - predicted)) AS e FROM ({stacked}) GROUP BY ALL) GROUP BY ALL)
  WINDOW e AS (PARTITION BY entity, indicator)"""


def model_rows(source: str, model: str, log: bool = False) -> str:
    f = "exp({0})" if log else "{0}"
    parts = ", ".join(f"{f.format(e)} AS {n}" for n, e in zip(BANDS, ["c", "c - w", "c + w", "c - 1.96 * w", "c + 1.96 * w"]))
    return f"SELECT entity, indicator, '{model}' AS model, h, CAST(last_period + to_months(h) AS DATE) AS period_start, {parts} FROM ({source})"


RATES, CREDIT = panel("rp", "monthly", REVERTING), panel("kp", "monthly", ["total_credit"])
UP = panel("up", "monthly", ["unemployment_rate"])
SMOOTH = """al AS (SELECT CAST(unnest(range(1, 20)) AS DOUBLE) / 20 AS alpha),
sm AS (SELECT a.entity, a.indicator, a.t, a.v, a.period_start, al.alpha, sum(b.v * CASE WHEN b.t = 0 THEN 1.0::DOUBLE ELSE alpha END * pow(1 - alpha, a.t - b.t)) AS s
  FROM up a JOIN up b ON a.entity = b.entity AND b.t <= a.t CROSS JOIN al GROUP BY ALL),
se AS (SELECT entity, indicator, alpha, sum(pow(v - p, 2)) AS sse FROM (SELECT *, lag(s) OVER (PARTITION BY entity, alpha ORDER BY t) AS p FROM sm) GROUP BY ALL),
ba AS (SELECT entity, indicator, arg_min(alpha, sse) AS alpha, min(sse) AS sse FROM se GROUP BY ALL)"""
SMOOTHED = """, sp AS (SELECT sm.entity, sm.indicator, sm.period_start, s AS v, lag(s) OVER (PARTITION BY sm.entity ORDER BY t) AS before FROM sm JOIN ba ON sm.entity = ba.entity AND sm.alpha = ba.alpha),
tg AS (SELECT entity, avg(v) AS target FROM up GROUP BY 1)"""
DEBT = """SELECT entity, is_capped, h, CAST(last_period + to_months(CAST(h AS INTEGER) * 3) AS DATE) AS period_start, round(c, 2) AS forecast, round(c - w, 2) AS lower_68, round(c + w, 2) AS upper_68,
  round(c - 1.96 * w, 2) AS lower_95, round(c + 1.96 * w, 2) AS upper_95 FROM (
  SELECT *, least(d, 500) AS c, d > 500 AS is_capped, sigma * sqrt(h) AS w FROM (SELECT *, debt * pow(a, h) - pb * CASE WHEN abs(a - 1) < 1e-12 THEN h ELSE (pow(a, h) - 1) / (a - 1) END AS d FROM (
  SELECT *, (1 + r) / (1 + g) AS a FROM (SELECT entity, arg_max(debt_to_gdp_ratio, period_start) AS debt, coalesce(avg(growth) FILTER (k <= 4), 0.005) AS g,
    arg_max(budget_deficit, period_start) / 4.0 AS pb, stddev_pop(move) AS sigma, max(period_start) AS last_period FROM (
    SELECT *, (nominal_gdp - lag(nominal_gdp) OVER w) / lag(nominal_gdp) OVER w AS growth, debt_to_gdp_ratio - lag(debt_to_gdp_ratio) OVER w AS move,
      row_number() OVER (PARTITION BY entity ORDER BY period_start DESC) AS k FROM quarterly WINDOW w AS (PARTITION BY entity ORDER BY period_start)) GROUP BY 1)
  JOIN (SELECT entity, pow(1 + arg_max(portugal_10y_bond_yield, period_start) FILTER (portugal_10y_bond_yield IS NOT NULL) / 100.0, 0.25) - 1 AS r FROM monthly GROUP BY 1) USING (entity))
  CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS h)))"""
GP = panel("gp", "quarterly", ["real_gdp"])
KEY = "entity, indicator, o"
GRID = "(SELECT row_number() OVER (ORDER BY a, b, g) - 1 AS i, a, b, g FROM (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) x(a), (VALUES (0.0::DOUBLE), (0.05), (0.2)) y(b), (VALUES (0.05::DOUBLE), (0.2), (0.5)) z(g))"


def origins(name: str, p: str, text: str) -> str:
    """``text``: the list of origins by n."""
    return f"""{name}_o AS MATERIALIZED (SELECT entity, indicator, unnest({text}) AS o, n, y, ps FROM (
  SELECT entity, indicator, count(*) AS n, list(v ORDER BY t) AS y, list(period_start ORDER BY t) AS ps FROM {p} GROUP BY 1, 2))"""


def holt_winters(name: str, cycle: int, steps: int) -> str:
    """A recursion over the values, one row for each series, origin and weight; ``name``_h has o, h, c, sigma and the actual value."""
    season = "r.ring[1]"
    level = f"(a * (v - {season}) + (1 - a) * (level + trend))"
    step = f"""SELECT r.entity, r.indicator, r.o, r.i, t + 1 AS t, {level} AS level, b * ({level} - level) + (1 - b) * trend AS trend,
    list_concat(r.ring[2:], [g * (v - {level}) + (1 - g) * {season}]) AS ring, sse + pow(v - (level + trend + {season}), 2) AS sse, sr + v - (level + trend + {season}) AS sr
    FROM (SELECT r.*, y[t + 1] AS v FROM r JOIN {name}_o USING ({KEY}) WHERE t < o) r JOIN gr ON gr.i = r.i"""
    return f"""{name}_r AS MATERIALIZED (WITH RECURSIVE gr AS MATERIALIZED (SELECT * FROM {GRID}), r AS (
  SELECT {KEY}, i, 0 AS t, list_avg(y[1:{cycle}]) AS level, (list_avg(y[{cycle + 1}:{2 * cycle}]) - list_avg(y[1:{cycle}])) / {cycle} AS trend,
    list_transform(y[1:{cycle}], lambda x: x - list_avg(y[1:{cycle}])) AS ring, 0.0::DOUBLE AS sse, 0.0::DOUBLE AS sr FROM {name}_o, gr WHERE o >= {2 * cycle}
  UNION ALL {step}) SELECT * FROM r),
{name}_h AS (SELECT {KEY}, h, ps[o] AS last_period, y[o + h] AS actual, level + h * trend + ring[(h - 1) % {cycle} + 1] AS c, sqrt(greatest(sse - sr * sr / o, 0) / (o - 1)) AS sigma
  FROM {name}_o LEFT JOIN (SELECT * FROM {name}_r WHERE t = o QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY sse, i) = 1) USING ({KEY}),
  (SELECT CAST(unnest(range(1, {steps + 1})) AS INTEGER) AS h))"""


def autoregression(name: str, p: str, steps: int) -> str:
    """All orders by elimination of one lag after the other and back substitution; ``name``_h as above, with detail."""
    key = "entity, indicator, o, d"
    on = " AND ".join("{0}." + c + " = m." + c for c in key.split(", ")) + " AND {0}.i = {1} AND {0}.j = {2}"
    steps_sql = "".join(f""", {name}_e{k} AS MATERIALIZED (SELECT {", ".join("m." + c for c in key.split(", "))}, m.i, m.j, m.v - CASE WHEN q.v > 1e-10 * g.v THEN r.v * c.v / q.v ELSE 0 END AS v
  FROM {name}_e{k - 1} m JOIN {name}_e{k - 1} q ON {on.format("q", k, k)} JOIN {name}_e{k - 1} r ON {on.format("r", "m.i", k)} JOIN {name}_e{k - 1} c ON {on.format("c", k, "m.j")}
  JOIN {name}_e0 g ON {on.format("g", k, k)} WHERE m.i > {k} AND m.j > {k})""" for k in range(1, 5))
    stacked = " UNION ALL ".join(f"SELECT *, {k} AS k FROM {name}_e{k}" for k in range(5))

    def at(k: int, i: int, j: int) -> str:
        return f"max(v) FILTER (k = {k} AND i = {i} AND j = {j})"

    pivots = ", ".join(f"CASE WHEN {at(k - 1, k, k)} > 1e-10 * {at(0, k, k)} THEN {at(k - 1, k, k)} END AS q{k}" for k in range(1, 5))
    upper = ", ".join(f"{at(i - 1, i, j)} AS u{i}{j}" for i in range(1, 5) for j in range(i + 1, 6))
    squares = ", ".join(f"greatest({at(k, 5, 5)}, 0) AS r{k - 1}" for k in range(1, 5))
    return f"""{name}_z AS (SELECT *, {", ".join(f"lag(z0, {k}) OVER w AS z{k}" for k in range(1, 5))} FROM (
  SELECT entity, indicator, CAST(t AS BIGINT) AS t, avg(v) OVER s AS mean, coalesce(nullif(stddev_samp(v) OVER s, 0), 1) AS sd, (v - avg(v) OVER s) / coalesce(nullif(stddev_samp(v) OVER s, 0), 1) AS z0
  FROM {p} WINDOW s AS (PARTITION BY entity, indicator)) WINDOW w AS (PARTITION BY entity, indicator ORDER BY t)),
{name}_e0 AS MATERIALIZED (SELECT {key}, i, j, sum(x[i] * x[j]) AS v FROM (SELECT entity, indicator, o, d, CASE WHEN d = 0 THEN [1.0::DOUBLE, z1, z2, z3, z0] ELSE [1.0::DOUBLE, z1 - z2, z2 - z3, z3 - z4, z0 - z1] END AS x
  FROM {name}_z JOIN {name}_o USING (entity, indicator), (VALUES (0), (1)) dd(d) WHERE t >= 4 AND t < o), (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j) GROUP BY ALL){steps_sql},
{name}_u AS (SELECT {key}, {pivots}, {upper}, {squares} FROM ({stacked}) GROUP BY ALL),
{name}_f AS (SELECT *, (o - 4) * ln(greatest(rss / (o - 4), 1e-300)) + 2 * (p + 2) AS aic FROM (
  SELECT u.*, p, mean, sd, z0, z1, z2, z3, CASE p WHEN 0 THEN r0 WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END * sd * sd AS rss FROM {name}_u u
  JOIN {name}_z z ON z.entity = u.entity AND z.indicator = u.indicator AND z.t = u.o - 1, (VALUES (0), (1), (2), (3)) pp(p) WHERE o - 4 >= p + 5)
  QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY aic, d, p) = 1),
{name}_b AS (SELECT *, (u15 - u12 * b2 - u13 * b3 - u14 * b4) / q1 AS b1 FROM (SELECT *, CASE WHEN p >= 1 THEN coalesce((u25 - u23 * b3 - u24 * b4) / q2, 0) ELSE 0 END AS b2 FROM (
  SELECT *, CASE WHEN p >= 2 THEN coalesce((u35 - u34 * b4) / q3, 0) ELSE 0 END AS b3 FROM (SELECT *, CASE WHEN p >= 3 THEN coalesce(u45 / q4, 0) ELSE 0 END AS b4 FROM {name}_f)))),
{name}_p AS (WITH RECURSIVE r AS (SELECT {KEY}, 0 AS h, CASE d WHEN 0 THEN z0 ELSE z0 - z1 END AS w1, CASE d WHEN 0 THEN z1 ELSE z1 - z2 END AS w2, CASE d WHEN 0 THEN z2 ELSE z2 - z3 END AS w3, z0 AS level,
    d, b1, b2, b3, b4, mean, sd, p, aic, sqrt(rss / (o - 5)) AS sigma FROM {name}_b
  UNION ALL SELECT {KEY}, h + 1, b1 + b2 * w1 + b3 * w2 + b4 * w3, w1, w2, CASE d WHEN 1 THEN level ELSE 0 END + b1 + b2 * w1 + b3 * w2 + b4 * w3, d, b1, b2, b3, b4, mean, sd, p, aic, sigma FROM r WHERE h < {steps})
  SELECT {KEY}, h, mean + sd * level AS c, sigma, printf('p=%d d=%d aic=%.2f', p, d, aic) AS detail FROM r WHERE h > 0),
{name}_h AS (SELECT {KEY}, x.h, ps[o] AS last_period, y[o + x.h] AS actual, c, sigma, coalesce(detail, 'series too short') AS detail
  FROM {name}_o CROSS JOIN (SELECT CAST(unnest(range(1, {steps + 1})) AS INTEGER) AS h) x LEFT JOIN {name}_p USING ({KEY}, h))"""


def wide_bands(name: str) -> str:
    return f"SELECT entity, indicator, last_period, h, c, sigma * sqrt(h) AS w FROM {name}_h"


def fitted_rows(name: str, model: str) -> str:
    return f"SELECT entity, indicator, '{model}' AS model, CAST(o AS INTEGER) AS origin, h, actual, c AS predicted FROM {name}_h"


LEADING = {"month": ["unemployment_rate", "hicp", "ecb_main_refinancing_rate", "total_credit"], "quarter": ["real_gdp", "debt_to_gdp_ratio"]}


def four_models() -> tuple[str, str, str]:
    """CTEs, forecasts and backtest rows of the four models on both grains."""
    ctes, rows, tests = [], [], []
    for grain, cycle, source, p in (("month", 12, "monthly", "mo"), ("quarter", 4, "quarterly", "qu")):
        splits = f"list_filter([n - {3 * cycle}, n - {2 * cycle}, n - {cycle}], lambda x: x >= 12)"
        ctes += [panel(p, source, LEADING[grain])]
        for kind, text in (("hf", "[n]"), ("hs", splits), ("af", "[n]"), ("as", splits)):
            name = f"{p}_{kind}"
            ctes += [origins(name, p, text), holt_winters(name, cycle, cycle) if kind[0] == "h" else autoregression(name, p, cycle)]
        for model, text in (("linear", line(p, cycle)), ("mean_reversion", revert(p, cycle)), ("holt_winters", wide_bands(f"{p}_hf")), ("autoregression", wide_bands(f"{p}_af"))):
            rows.append(model_rows(text, model).replace("to_months(h)", f"to_months(h * {3 if grain == 'quarter' else 1})"))
        test = f"(o.n - o.t - 1) IN ({cycle}, {2 * cycle}, {3 * cycle}) AND o.t + 1 >= 12"
        tests += [backtest(p, m, cycle, test) for m in ("linear", "mean_reversion")] + [fitted_rows(f"{p}_hs", "holt_winters"), fitted_rows(f"{p}_as", "autoregression")]
    stacked = " UNION ALL ".join(f"SELECT entity, indicator, model, origin, h, actual, predicted FROM ({t})" for t in tests)
    ctes.append(f"""sc AS MATERIALIZED (SELECT entity, indicator, model, origin, CASE WHEN count(predicted) = count(*) THEN avg(abs(actual - predicted)) END AS e FROM ({stacked}) GROUP BY ALL),
wt AS (SELECT *, CASE WHEN sum(CASE WHEN mae > 0 THEN 1 / mae END) OVER s IS NULL THEN 1.0::DOUBLE / count(*) OVER s ELSE coalesce(CASE WHEN mae > 0 THEN 1 / mae END, 0) / sum(CASE WHEN mae > 0 THEN 1 / mae END) OVER s END AS weight
  FROM (SELECT entity, indicator, model, count(*) AS origins, CASE WHEN count(e) = count(*) THEN avg(e) END AS mae FROM sc GROUP BY ALL) WINDOW s AS (PARTITION BY entity, indicator))""")
    return ", ".join(ctes), " UNION ALL ".join(rows), stacked


FOUR, FOUR_ROWS, _ = four_models()
HOLT = ", ".join([panel("hp", "monthly", ["unemployment_rate", "hicp"]), origins("hw", "hp", "[n]"), holt_winters("hw", 12, 12)])
ORDER = ", ".join([GP, origins("ar", "gp", "[n]"), autoregression("ar", "gp", 8)])

SQL = {
    "seasonal_forecast": facts(bands(wide_bands("hw"), 12, "month", 2), extra=HOLT),
    "order_search_forecast": facts(bands("SELECT entity, indicator, last_period, h, c, sigma * sqrt(h) AS w, detail FROM ar_h", 8, "quarter", 2, extra=", detail"), "quarterly", extra=ORDER),
    "full_ensemble": facts(f"""SELECT entity, indicator, h, period_start, {", ".join(f"round(sum({b} * weight), 2) AS {b}" for b in BANDS)} FROM ({FOUR_ROWS}) JOIN wt USING (entity, indicator, model) GROUP BY 1, 2, 3, 4""",
                           "monthly", "quarterly", extra=FOUR),
    "ensemble_status": facts("SELECT entity, indicator, model, origins, round(mae, 4) AS mae, round(weight, 4) AS weight, CASE WHEN mae IS NULL THEN 'failed' ELSE 'ok' END AS status FROM wt", "monthly", "quarterly", extra=FOUR),
    "gdp_forecast": facts("SELECT *, year(period_start) || '-Q' || quarter(period_start) AS date_key FROM (" + bands(line("gp", 8, LOG, True), 8, "quarter", 2, True, ", n") + ")",
                          "quarterly", extra=GP),
    "credit_forecast": facts("SELECT *, strftime(period_start, '%Y-%m') AS date_key FROM (" + bands(line("cp", 12, LOG, True), 12, "month", 2, True, ", n") + ")",
                             extra=panel("cp", "monthly", ["total_credit"], 36)),
    "credit_growth": facts(f"""SELECT entity, indicator, count(*) AS n, round(regr_slope({LOG}, t), 6) AS slope, round(regr_r2({LOG}, t), 4) AS r_squared,
  round((exp(regr_slope({LOG}, t) * 12) - 1) * 100, 4) AS annual_growth FROM cp GROUP BY 1, 2""", extra=panel("cp", "monthly", ["total_credit"], 36)),
    "rate_forecast": facts(bands(revert("xp", 12), 12, "month", 3, extra=", m AS n"), extra=panel("xp", "monthly", ["ecb_main_refinancing_rate", "euribor_12m"])),
    "inflation_forecast": facts(bands(revert("xp", 12, "2.0::DOUBLE"), 12, "month", 2, extra=", m AS n"), extra=panel("xp", "monthly", ["hicp"])),
    "smoothing_weights": facts("SELECT entity, indicator, alpha, round(sse, 3) AS sse FROM ba", extra=UP + ", " + SMOOTH),
    "unemployment_forecast": facts(bands(revert("sp", 12, "target").replace("FROM sp GROUP BY 1, 2", "FROM sp GROUP BY 1, 2) JOIN tg USING (entity"), 12, "month", 2, extra=", m AS n"),
                                   extra=UP + ", " + SMOOTH + SMOOTHED),
    "trend_forecast": facts(bands(line("rp", 12), 12, "month", 3, extra=", n"), extra=RATES),
    "debt_forecast": facts(DEBT, "monthly", "quarterly"),
    "backtest_origins": facts(scored(backtest("gp", "log_linear", 4, EXPAND.format(12, 4)), "entity, indicator, model, origin"), "quarterly", extra=GP),
    "backtest_gdp": facts(scored(backtest("gp", "log_linear", 4, EXPAND.format(12, 4)), "entity, indicator, model"), "quarterly", extra=GP),
    "backtest_unemployment": facts(scored(backtest("up", "mean_reversion", 12, EXPAND.format(36, 12)), "entity, indicator, model"), extra=UP),
    "ensemble_weights": facts(f"SELECT entity, indicator, model, round(mae, 4) AS mae, round(weight, 4) AS weight FROM ({weights('rp', ['linear', 'mean_reversion'])})", extra=RATES),
    "ensemble_forecast": facts(f"""SELECT entity, indicator, h, period_start, {", ".join(f"round(sum({b} * weight), 2) AS {b}" for b in BANDS)} FROM (
{model_rows(line("rp", 12), "linear")} UNION ALL {model_rows(line("kp", 12), "linear")} UNION ALL {model_rows(revert("rp", 12), "mean_reversion")}
UNION ALL {model_rows(line("kp", 12, LOG, True), "log_linear", True)}) JOIN ({weights('rp', ['linear', 'mean_reversion'])} UNION ALL {weights('kp', ['linear', 'log_linear'])})
USING (entity, indicator, model) GROUP BY 1, 2, 3, 4""", extra=RATES + ", " + CREDIT),
}
