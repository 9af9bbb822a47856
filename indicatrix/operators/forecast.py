"""Forecasts and backtests of many series at once.

Trend, log-trend and mean-reversion models have closed forms, so a fit is an aggregation, a path is an expression over
``sequence(1, horizon)``, and every expanding-window origin is a prefix window aggregate: nothing is refitted in a loop.
Models without a closed form are folds over one array per series or sweeps of running sums; only a user's own model runs as a grouped pandas function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from indicatrix.functions.keys import add_periods
from indicatrix.functions.numeric import ratio, rounded
from indicatrix.operators.folds import autoregressive_path, seasonal_fit, seasonal_path, series_array, smoothed, spread
from indicatrix.operators.regression import coefficient, gram, residual_square, standardized, sweep
from indicatrix.operators.windows import by_series

LONG = ("entity", "indicator")
BANDS = ("forecast", "lower_68", "upper_68", "lower_95", "upper_95")
LOG_FLOOR = 1e-6


def numbered(panel: DataFrame, series: Sequence[str] = LONG, period: str = "period_start", value: str = "value") -> DataFrame:
    """Known rows with t = 0, 1, ... and the previous value."""
    order = by_series(series, period)
    known = panel.where(F.col(value).isNotNull())
    return known.withColumn("t", (F.row_number().over(order) - 1).cast("double")).withColumn("before", F.lag(value).over(order))


def _line(y: Column, x: Column, over: Callable[[Column], Column] = lambda c: c) -> dict[str, Column]:
    return {"n": over(F.regr_count(y, x)), "a": over(F.regr_intercept(y, x)), "b": over(F.regr_slope(y, x)), "sxx": over(F.regr_sxx(y, x)),
            "syy": over(F.regr_syy(y, x)), "sxy": over(F.regr_sxy(y, x))}


def _residual_sd(m: str, ddof: int) -> Column:
    n, sxx, syy, sxy = (F.col(f"{m}.{c}") for c in ("n", "sxx", "syy", "sxy"))
    rss = F.greatest(syy - sxy * sxy / F.when(sxx > 0, sxx), F.lit(0.0))
    return F.sqrt(rss / F.when(n > ddof, n - ddof))


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def _banded(fit: DataFrame, series: Sequence[str], horizon: int, center: Column, width: Column, grain: str, log: bool = False, enough: Column | None = None,
            more: Sequence[Column] = ()) -> DataFrame:
    """Expand fits to h = 1..horizon; ``center`` and ``width`` may use the column h. Where a fit has not ``enough`` values its rows stay, without numbers."""
    wrap = F.exp if log else (lambda c: c)
    known = F.lit(True) if enough is None else enough
    path = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_c", F.when(known, center)).withColumn("_w", F.when(known, width))
    c, w = F.col("_c"), F.col("_w")
    return path.select(*series, *more, "h", add_periods(F.col("last_period"), F.col("h"), grain).alias("period_start"), wrap(c).alias("forecast"),
                       wrap(c - w).alias("lower_68"), wrap(c + w).alias("upper_68"), wrap(c - 1.96 * w).alias("lower_95"), wrap(c + 1.96 * w).alias("upper_95"))


def log_linear(panel: DataFrame, horizon: int, grain: str, series: Sequence[str] = LONG) -> DataFrame:
    """ln(y) = a + b t with constant bands in logs."""
    y = F.ln(F.greatest(F.col("value"), F.lit(LOG_FLOOR)))
    fit = numbered(panel, series).groupBy(*series).agg(_struct(_line(y, F.col("t"))).alias("m"), F.max("period_start").alias("last_period"), F.max("t").alias("last_t"))
    return _banded(fit, series, horizon, F.col("m.a") + F.col("m.b") * (F.col("last_t") + F.col("h")),
                   F.greatest(_residual_sd("m", 2), F.lit(1e-10)), grain, log=True, enough=F.col("m.n") >= 3, more=[F.col("m.n")])


def log_linear_growth(panel: DataFrame, periods_per_year: int, series: Sequence[str] = LONG) -> DataFrame:
    """Slope, r2 and annualised growth of the log trend."""
    y = F.ln(F.greatest(F.col("value"), F.lit(LOG_FLOOR)))
    m = numbered(panel, series).groupBy(*series).agg(_struct(_line(y, F.col("t"))).alias("m"))
    enough = F.col("m.n") >= 3
    r2 = F.col("m.sxy") * F.col("m.sxy") / F.when((F.col("m.sxx") > 0) & (F.col("m.syy") > 0), F.col("m.sxx") * F.col("m.syy"))
    return m.select(*series, F.col("m.n").alias("n"), F.when(enough, rounded("m.b", 6)).alias("slope"), F.when(enough, rounded(r2, 4)).alias("r_squared"),
                    F.when(enough, rounded((F.exp(F.col("m.b") * periods_per_year) - 1) * 100, 4)).alias("annual_growth"))


def linear_trend(panel: DataFrame, horizon: int, grain: str, series: Sequence[str] = LONG) -> DataFrame:
    fit = numbered(panel, series).groupBy(*series).agg(_struct(_line(F.col("value"), F.col("t"))).alias("m"), F.max("period_start").alias("last_period"),
                                                       F.max("t").alias("last_t"))
    return _banded(fit, series, horizon, F.col("m.a") + F.col("m.b") * (F.col("last_t") + F.col("h")),
                   _residual_sd("m", 2) * F.sqrt(1 + F.col("h") / F.col("m.n")), grain, enough=F.col("m.n") >= 3, more=[F.col("m.n")])


def _speed(m: str) -> Column:
    """Reversion speed from the regression of changes on the previous level: minus its slope, floored."""
    flat = F.col(f"{m}.sxx") / F.when(F.col(f"{m}.n") > 0, F.col(f"{m}.n")) <= 1e-12
    return F.when(F.coalesce(flat, F.lit(True)), 0.05).otherwise(F.greatest(-F.col(f"{m}.b"), F.lit(0.001)))


def mean_reversion(panel: DataFrame, horizon: int, grain: str, target: float | None = None, targets: DataFrame | None = None,
                   series: Sequence[str] = LONG) -> DataFrame:
    """Exponential approach to a target: a fixed one, one per series (``targets`` with column ``target``), or the series' mean."""
    moves = numbered(panel, series)
    fit = moves.groupBy(*series).agg(_struct(_line(F.col("value") - F.col("before"), F.col("before"))).alias("m"), F.avg("value").alias("mean"),
                                     F.max_by("value", "period_start").alias("last"), F.max("period_start").alias("last_period"))
    fit = fit.join(targets, list(series)) if targets is not None else fit.withColumn("target", F.lit(target) if target is not None else F.col("mean"))
    k, n = F.col("k"), F.col("m.n")
    fit = fit.withColumn("k", _speed("m"))
    # residual = change - k (target - previous) = change + k previous + constant
    spread = F.col("m.syy") + 2 * k * F.col("m.sxy") + k * k * F.col("m.sxx")
    fit = fit.withColumn("sigma", F.sqrt(F.greatest(spread, F.lit(0.0)) / F.when(n > 1, n - 1)))
    width = F.sqrt(F.col("sigma") * F.col("sigma") / (2 * k) * (1 - F.exp(-2 * k * F.col("h"))))
    return _banded(fit, series, horizon, F.col("target") + (F.col("last") - F.col("target")) * F.pow(1 - k, F.col("h")), width, grain, enough=n >= 2, more=[n])


# ---- exponential smoothing ----------------------------------------------------------------------------------------

def _observations(panel: DataFrame, series: Sequence[str]) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col("period_start").alias("p"), F.col("value").alias("v"))))
    return panel.where(F.col("value").isNotNull()).groupBy(*series).agg(pairs.alias("obs"))


def best_alpha(panel: DataFrame, grid: Sequence[float], series: Sequence[str] = LONG) -> DataFrame:
    """Smoothing weight with the smallest one-step error on a grid, each weight a fold over the series' one array; of equal errors the smaller weight."""
    rest = F.slice("obs", F.lit(2), F.greatest(F.size("obs") - 1, F.lit(0)))

    def error(alpha: Column) -> Column:
        start = F.struct(F.col("obs")[0]["v"].alias("s"), F.lit(0.0).alias("sse"))
        return F.aggregate(rest, start, lambda acc, x: F.struct((alpha * x["v"] + (1 - alpha) * acc["s"]).alias("s"), (acc["sse"] + (x["v"] - acc["s"]) * (x["v"] - acc["s"])).alias("sse")))["sse"]

    weights = F.array(*[F.lit(float(a)) for a in grid])
    best = F.array_min(F.transform(weights, lambda a: F.struct(error(a).alias("sse"), a.alias("alpha"))))
    return _observations(panel, series).select(*series, best.alias("best")).select(*series, "best.alpha", "best.sse")


def smooth_with(panel: DataFrame, alphas: DataFrame, series: Sequence[str] = LONG) -> DataFrame:
    """Each series smoothed with its own weight."""
    joined = series_array(panel, series).join(alphas.select(*series, "alpha"), list(series))
    rows = F.arrays_zip("periods", smoothed(F.col("y"), F.col("alpha")).alias("s"))
    return joined.select(*series, F.inline(rows).alias("period_start", "value"))


# ---- debt path ----------------------------------------------------------------------------------------------------

def debt_path(start: DataFrame, horizon: int, grain: str = "quarter", cap: float = 500.0, series: Sequence[str] = ("entity",)) -> DataFrame:
    """d' = d (1 + r) / (1 + g) - pb in closed form, cut at a cap, with a column that says where. ``start`` has debt, r, g, pb, sigma and last_period per series."""
    a = (1 + F.col("r")) / F.when(F.abs(1 + F.col("g")) > 1e-6, 1 + F.col("g")).otherwise(1e-6)
    fit = start.withColumn("a", a)
    power = F.pow("a", F.col("h"))
    total = F.when(F.abs(F.col("a") - 1) < 1e-12, F.col("h").cast("double")).otherwise((power - 1) / (F.col("a") - 1))
    path = F.col("debt") * power - F.col("pb") * total
    return _banded(fit, series, horizon, F.least(path, F.lit(cap)), F.col("sigma") * F.sqrt("h"), grain, more=[(path > cap).alias("is_capped")])


# ---- backtests ----------------------------------------------------------------------------------------------------

def _prefix(series: Sequence[str]) -> Callable[[Column], Column]:
    order = Window.partitionBy(*series).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return lambda c: c.over(order)


def _path(model: str, horizon: int) -> Column:
    steps = F.sequence(F.lit(1), F.lit(horizon))
    if model == "linear":
        return F.transform(steps, lambda h: F.col("lin.a") + F.col("lin.b") * (F.col("t") + h))
    if model == "log_linear":
        return F.transform(steps, lambda h: F.exp(F.col("log.a") + F.col("log.b") * (F.col("t") + h)))
    if model == "mean_reversion":
        return F.transform(steps, lambda h: F.col("mean") + (F.col("value") - F.col("mean")) * F.pow(1 - F.col("k"), h))
    raise ValueError(f"unknown model {model!r}")


def prefix_forecasts(panel: DataFrame, models: Sequence[str], step_ahead: int, is_origin: Column, series: Sequence[str] = LONG) -> DataFrame:
    """Forecasts from every origin row: ``series, model, origin, h, actual, predicted``.

    The fit at an origin uses the rows up to it only, as a running aggregate; actuals are read ahead in the same window.
    ``is_origin`` may use t (rows so far minus one) and n (length of the series).
    """
    base = numbered(panel, series).withColumn("n", F.count("*").over(Window.partitionBy(*series)))
    run = _prefix(series)
    fits = {}
    if "linear" in models:
        fits["lin"] = _struct(_line(F.col("value"), F.col("t"), run))
    if "log_linear" in models:
        fits["log"] = _struct(_line(F.ln(F.greatest(F.col("value"), F.lit(LOG_FLOOR))), F.col("t"), run))
    if "mean_reversion" in models:
        fits["rev"] = _struct(_line(F.col("value") - F.col("before"), F.col("before"), run))
        fits["mean"] = run(F.avg("value"))
    ahead = by_series(series, "t")
    fits["actuals"] = F.array(*[F.lead("value", h).over(ahead) for h in range(1, step_ahead + 1)])
    fitted = base.withColumns(fits).where(is_origin & (F.col("t") + step_ahead < F.col("n")))
    if "mean_reversion" in models:
        fitted = fitted.withColumn("k", _speed("rev"))
    paths = F.array(*[F.struct(F.lit(m).alias("model"), _path(m, step_ahead).alias("path")) for m in models])
    rows = fitted.withColumn("_p", F.explode(paths)).select(
        *series, F.col("_p.model").alias("model"), (F.col("t") + 1).cast("int").alias("origin"),
        F.inline(F.arrays_zip(F.sequence(F.lit(1), F.lit(step_ahead)).alias("h"), F.col("actuals").alias("actual"), F.col("_p.path").alias("predicted"))))
    return rows.toDF(*series, "model", "origin", "h", "actual", "predicted")


def expanding_origins(min_train: int, step_size: int) -> Column:
    return (F.col("t") + 1 >= min_train) & ((F.col("t") + 1 - min_train) % step_size == 0)


def last_splits(n_splits: int, test_size: int, min_train: int = 12) -> Column:
    back = F.col("n") - (F.col("t") + 1)
    return (back % test_size == 0) & back.between(test_size, n_splits * test_size) & (F.col("t") + 1 >= min_train)


def udf_forecasts(panel: DataFrame, name: str, fn: Callable[[np.ndarray, int], np.ndarray], step_ahead: int, origins: Callable[[int], Sequence[int]],
                  series: Sequence[str] = LONG) -> DataFrame:
    """The same rows for a model given as ``fn(train, horizon) -> predictions``; a failing origin has rows without a prediction."""
    keys = [f"{c} {t}" for c, t in panel.select(*series).dtypes]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, out = rows.sort_values("period_start")["value"].to_numpy(dtype=float), []
        for origin in origins(len(y)):
            try:
                predicted = np.asarray(fn(y[:origin], step_ahead), dtype=float)
            except (ValueError, np.linalg.LinAlgError):
                predicted = np.full(step_ahead, np.nan)  # null in Spark
            out += [(*key, name, origin, h + 1, float(y[origin + h]), float(predicted[h])) for h in range(step_ahead)]
        return pd.DataFrame(out, columns=[*series, "model", "origin", "h", "actual", "predicted"])

    known = panel.where(F.col("value").isNotNull()).select(*series, "period_start", "value")
    return known.groupBy(*series).applyInPandas(run, ", ".join([*keys, "model string, origin int, h int, actual double, predicted double"]))


def metrics(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE, RMSE, MAPE (zero actuals skipped) and directional accuracy (within an origin only) per group."""
    order = Window.partitionBy(*[c for c in (*LONG, "model", "origin") if c in forecasts.columns]).orderBy("h")
    moved = forecasts.withColumn("_da", F.col("actual") - F.lag("actual").over(order)).withColumn("_dp", F.col("predicted") - F.lag("predicted").over(order))
    error = F.col("actual") - F.col("predicted")
    hit = F.when(F.col("_da").isNotNull(), F.when((F.col("_da") >= 0) == (F.col("_dp") >= 0), 100.0).otherwise(0.0))
    return moved.groupBy(*by).agg(F.count("*").alias("n"), rounded(F.avg(F.abs(error)), 4).alias("mae"), rounded(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
                                  rounded(F.avg(F.abs(ratio(error, "actual"))) * 100).alias("mape"), rounded(F.avg(hit), 1).alias("directional_accuracy_pct"))


def model_weights(forecasts: DataFrame, series: Sequence[str] = LONG) -> DataFrame:
    """Inverse-MAE weights over the models of a series that predicted from every origin; equal weights where no model has a usable error."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    per_origin = forecasts.groupBy(*series, "model", "origin").agg(F.when(F.count("predicted") == F.count("*"), F.avg(error)).alias("e"))
    scores = per_origin.groupBy(*series, "model").agg(F.when(F.count("e") == F.count("*"), F.avg("e")).alias("mae"))
    usable = (F.col("mae") > 0) & (F.col("mae") < float("inf"))
    whole = Window.partitionBy(*series)
    inverse = F.when(usable, 1.0 / F.col("mae"))
    total = F.sum(inverse).over(whole)
    return scores.withColumn("weight", F.when(total.isNull(), 1.0 / F.count("*").over(whole)).otherwise(F.coalesce(inverse, F.lit(0.0)) / total))


def ensemble(forecasts: DataFrame, weights: DataFrame, series: Sequence[str] = LONG) -> DataFrame:
    """Weighted sum of the models' forecasts and bands."""
    joined = forecasts.join(weights.select(*series, "model", "weight"), [*series, "model"])
    return joined.groupBy(*series, "h", "period_start").agg(*[rounded(F.sum(F.col(c) * F.col("weight"))).alias(c) for c in BANDS])


# ---- seasonal smoothing and order search --------------------------------------------------------------------------

ORDERS = 3


def holt_winters_fits(panel: DataFrame, cycle: int, origins: Column, horizon: int, series: Sequence[str] = LONG) -> DataFrame:
    """``series, origin, n, last_period, path, sigma`` for each origin (number of values the fit may use; the array ``origins`` may use n); y and the path null below two cycles."""
    rows = series_array(panel, series).withColumn("n", F.size("y"))
    rows = rows.withColumn("origin", F.explode(origins)).withColumn("_y", F.slice("y", F.lit(1), F.col("origin")))
    fitted = rows.withColumn("_f", seasonal_fit(F.col("_y"), cycle))
    return fitted.select(*series, "origin", "n", "y", F.get("periods", F.col("origin") - 1).alias("last_period"), F.when(F.col("_f").isNotNull(), seasonal_path(F.col("_f"), cycle, horizon)).alias("path"),
                         spread(F.col("_f.sse"), F.col("_f.sr"), F.col("origin")).alias("sigma"))


def autoregression_fits(panel: DataFrame, is_origin: Column, horizon: int, series: Sequence[str] = LONG) -> DataFrame:
    """``series, origin, n, last_period, path, sigma, p, d, aic`` at every row that ``is_origin`` (may use t and n) names; path null where no order has enough values.

    The Gram matrices of levels and of changes on their last three values are running sums, so every origin has its own fit without a refit; all orders come
    from sweeping one more column each, on the same rows, and the smallest AIC wins (of equal ones the fewer differences, then the smaller order).
    """
    order = by_series(series, "period_start")
    known = panel.where(F.col("value").isNotNull()).select(*series, "period_start", F.col("value").cast("double").alias("value"))
    z = standardized(known, "value", series).withColumn("t", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*series)))
    z = z.withColumns({f"_z{k}": F.lag("z", k).over(order) for k in range(1, ORDERS + 2)}).withColumnRenamed("z", "_z0")
    levels = [F.col(f"_z{k}") for k in range(ORDERS + 1)]
    changes = [F.col(f"_z{k}") - F.col(f"_z{k + 1}") for k in range(ORDERS + 1)]
    sample = F.col("t") >= ORDERS + 1
    grams = {f"_g{d}": gram([F.lit(1.0), *w[1:], w[0]], sample, _prefix(series)) for d, w in enumerate((levels, changes))}
    rows = z.withColumns(grams).where(is_origin).withColumn("origin", F.col("t") + 1)
    used = (F.col("origin") - ORDERS - 1).cast("double")
    target = ORDERS + 1
    for d in (0, 1):
        for p in range(ORDERS + 1):
            rows = rows.withColumn(f"_s{d}{p}", sweep(F.col(f"_g{d}"), p + 1))

    def fit(d: int, p: int) -> Column:
        s = F.col(f"_s{d}{p}")
        rss = residual_square(s, target) * F.col("_sd") * F.col("_sd")
        aic = used * F.ln(F.greatest(rss / F.when(used > 0, used), F.lit(1e-300))) + 2 * (p + 2)
        beta = F.array(*[coefficient(s, k, target) if k <= p else F.lit(0.0) for k in range(target)])
        return F.when(used >= p + 5, F.struct(aic.alias("aic"), F.lit(d).alias("d"), F.lit(p).alias("p"), rss.alias("rss"), beta.alias("beta")))

    rows = rows.withColumn("_f", F.array_min(F.filter(F.array(*[fit(d, p) for d in (0, 1) for p in range(ORDERS + 1)]), lambda f: f.isNotNull())))
    differenced = F.col("_f.d") == 1
    last = [F.when(differenced, change).otherwise(level) for change, level in zip(changes[:ORDERS], levels[:ORDERS])]
    path = autoregressive_path([F.col("_f.beta")[k] for k in range(target)], last, F.col("_z0"), differenced, horizon)
    raw = F.when(F.col("_f").isNotNull(), F.transform(path, lambda v: F.col("_mean") + F.col("_sd") * v))
    return rows.select(*series, "origin", "n", F.col("period_start").alias("last_period"), raw.alias("path"), F.sqrt(F.col("_f.rss") / F.when(used > 1, used - 1)).alias("sigma"), "_f.p", "_f.d", "_f.aic")


def _spread_out(fits: DataFrame, detail: Column, horizon: int, grain: str, series: Sequence[str]) -> DataFrame:
    """A row for each step with bands growing as sqrt(h); a fit without a path keeps its rows, without values and with the reason as detail."""
    steps = F.arrays_zip(F.sequence(F.lit(1), F.lit(horizon)).alias("h"), F.coalesce("path", F.array_repeat(F.lit(None).cast("double"), horizon)).alias("c"))
    rows = fits.withColumn("detail", detail).select(*series, "last_period", "sigma", "detail", F.inline(steps))
    c, w = F.col("c"), F.col("sigma") * F.sqrt("h")
    return rows.select(*series, "h", add_periods(F.col("last_period"), F.col("h"), grain).alias("period_start"), c.alias("forecast"), (c - w).alias("lower_68"),
                       (c + w).alias("upper_68"), (c - 1.96 * w).alias("lower_95"), (c + 1.96 * w).alias("upper_95"), "detail")


def holt_winters(panel: DataFrame, horizon: int, grain: str, cycle: int, series: Sequence[str] = LONG) -> DataFrame:
    """Additive Holt-Winters of every series on a grid of weights."""
    fits = holt_winters_fits(panel, cycle, F.array("n"), horizon, series)
    return _spread_out(fits, F.when(F.col("path").isNull(), "series shorter than two cycles").otherwise(""), horizon, grain, series)


def autoregression(panel: DataFrame, horizon: int, grain: str, series: Sequence[str] = LONG) -> DataFrame:
    """AR(p) of the values or their changes, up to three lags, with the smallest AIC."""
    fits = autoregression_fits(panel, F.col("t") == F.col("n") - 1, horizon, series)
    found = F.format_string("p=%d d=%d aic=%.2f", F.col("p"), F.col("d"), F.col("aic"))
    return _spread_out(fits, F.when(F.col("path").isNull(), "series too short").otherwise(found), horizon, grain, series)


def split_forecasts(fits: DataFrame, panel: DataFrame, name: str, step_ahead: int, series: Sequence[str] = LONG) -> DataFrame:
    """Backtest rows (as ``prefix_forecasts``) of fits at their origins; a fit without a path has rows without a prediction."""
    actual = panel.where(F.col("value").isNotNull()).select(*series, F.col("value").alias("actual"), F.row_number().over(by_series(series, "period_start")).alias("_at"))
    steps = F.arrays_zip(F.sequence(F.lit(1), F.lit(step_ahead)).alias("h"), F.coalesce("path", F.array_repeat(F.lit(None).cast("double"), step_ahead)).alias("predicted"))
    rows = fits.select(*series, F.lit(name).alias("model"), F.col("origin").cast("int").alias("origin"), F.inline(steps)).withColumn("_at", F.col("origin") + F.col("h"))
    return rows.join(actual, [*series, "_at"]).select(*series, "model", "origin", "h", "actual", "predicted")
