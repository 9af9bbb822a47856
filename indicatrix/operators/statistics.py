"""Statistical operators: every series in one job, moments by Spark, tail probabilities on the aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from indicatrix.functions.numeric import ratio, rounded
from indicatrix.functions.tails import f_p_value, t_p_value, t_two_sided_quantile
from indicatrix.operators.joins import label_periods
from indicatrix.operators.regression import TOLERANCE, coefficient, gram, residual_square, standardized, sweep
from indicatrix.operators.windows import by_series, change, lagged

LONG = ("entity", "indicator")


# ---- correlation --------------------------------------------------------------------------------------------------

def moments(y: Column | str, x: Column | str) -> Column:
    """n, sxx, syy and sxy of the complete pairs, as one struct of built-in aggregates."""
    return F.struct(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
                    F.regr_sxy(y, x).alias("sxy"))


def pearson(m: Column, min_n: int = 3, tiny: float = 1e-12) -> Column:
    """r from the moments; null with fewer than ``min_n`` pairs or a constant side."""
    r = m["sxy"] / F.sqrt(F.when((m["sxx"] > tiny) & (m["syy"] > tiny), m["sxx"] * m["syy"]))
    return F.when((m["n"] >= min_n) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation_t(r: Column, n: Column) -> Column:
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r))).when(
        (n > 2) & r.isNotNull(), F.lit(float("inf")))


def with_correlation(df: DataFrame, m: str = "m", min_n: int = 3) -> DataFrame:
    """Replace a moments struct by ``n, r, p_value`` and a strength label."""
    r, n = pearson(F.col(m), min_n), F.col(f"{m}.n")
    out = df.withColumn("_r", r).withColumn("n", n).withColumn(
        "p_value", rounded(t_p_value(correlation_t(F.col("_r"), n), (n - 2).cast("double")), 6))
    out = out.withColumn("r", rounded("_r", 4)).drop(m, "_r")
    return out.withColumn("strength", strength(F.col("r"))).withColumn("significant", F.col("p_value") < 0.05)


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(r.isNull(), "insufficient data").when(size >= 0.7, "strong").when(size >= 0.4, "moderate").otherwise("weak")


def pair_correlations(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("entity",), min_n: int = 3) -> DataFrame:
    """Correlation of every pair of ``columns`` (a fixed list of indicators), per group, each pair over the rows that have both.

    A row becomes one row for each pair, which the map side sums to one for each group and pair before anything is shuffled: the code of the sums has the size of
    one pair, however many indicators there are. A row that lacks a side adds nothing to its pair.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    values = wide.select(*by, F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])).alias("_p")
    rows = values.select(*by, "_v", at).select(*by, F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), F.col("_v")[F.col("_p.i")].alias("_x"), F.col("_v")[F.col("_p.j")].alias("_y"))
    sums = rows.groupBy(*by, "_i", "_j").agg(moments("_y", "_x").alias("m"))
    names = F.array(*[F.lit(c) for c in columns])
    return with_correlation(sums.select(*by, names[F.col("_i")].alias("a"), names[F.col("_j")].alias("b"), "m"), min_n=min_n)


def difference_columns(wide: DataFrame, columns: Sequence[str], non_stationary: DataFrame | None = None,
                       series: Sequence[str] = ("entity",)) -> DataFrame:
    """First differences of ``columns``: of all of them, or only where ``non_stationary`` (entity, indicator) says so."""
    if non_stationary is None:
        return wide.withColumns({c: change(c, 1, series=series) for c in columns})
    flags = non_stationary.groupBy(*series).agg(*[
        F.coalesce(F.max(F.when(F.col("indicator") == c, ~F.col("is_stationary"))), F.lit(False)).alias(f"_d_{c}") for c in columns])
    joined = wide.join(flags, list(series), "left")
    return joined.withColumns({c: F.when(F.coalesce(F.col(f"_d_{c}"), F.lit(False)), change(c, 1, series=series)).otherwise(F.col(c))
                               for c in columns}).drop(*[f"_d_{c}" for c in columns])


def redundant_total(wide: DataFrame, total: str, parts: Sequence[str], by: Sequence[str] = ("entity",), min_n: int = 5,
                    threshold: float = 0.999) -> DataFrame:
    """Is a total nearly the sum of its parts? ``|r| > threshold`` over complete rows."""
    sum_of_parts = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    m = wide.groupBy(*by).agg(moments(sum_of_parts, total).alias("m"))
    r = pearson(F.col("m"), min_n)
    return m.select(*by, F.lit(total).alias("total"), F.col("m.n").alias("n"), rounded(r, 6).alias("r"),
                    F.coalesce(F.abs(r) > threshold, F.lit(False)).alias("is_redundant"))


# ---- trend, periods, breaks ---------------------------------------------------------------------------------------

def trend_test(panel: DataFrame, series: Sequence[str] = LONG, period: str = "period_start", value: str = "value",
               alpha: float = 0.05) -> DataFrame:
    """OLS trend on t = 0..n-1: slope, intercept, r2, standard error, p; null below three observations."""
    known = panel.where(F.col(value).isNotNull()).withColumn("_t", (F.row_number().over(by_series(series, period)) - 1).cast("double"))
    m = known.groupBy(*series).agg(moments(value, "_t").alias("m"), F.regr_slope(value, "_t").alias("b"), F.regr_intercept(value, "_t").alias("a"))
    n, sxx, syy, sxy = (F.col(f"m.{c}") for c in ("n", "sxx", "syy", "sxy"))
    enough = n >= 3
    rss = F.greatest(syy - sxy * sxy / F.when(sxx > 0, sxx), F.lit(0.0))
    err = F.sqrt(rss / F.when(n > 2, n - 2) / F.when(sxx > 0, sxx))
    out = m.select(*series, n.alias("n"), F.when(enough, F.col("b")).alias("b"), F.when(enough, F.col("a")).alias("a"),
                   F.when(enough, sxy * sxy / F.when((sxx > 0) & (syy > 0), sxx * syy)).alias("r2"), F.when(enough, err).alias("se"))
    p = t_p_value(ratio("b", "se"), (F.col("n") - 2).cast("double"))
    return out.withColumn("p_value", rounded(p, 6)).select(
        *series, "n", rounded("b", 6).alias("slope"), rounded("a", 4).alias("intercept"), rounded("r2", 4).alias("r_squared"),
        rounded("se", 6).alias("std_err"), "p_value", (F.col("p_value") < alpha).alias("significant"))


def period_stats(panel: DataFrame, periods: Sequence[tuple[str, int, int]], series: Sequence[str] = LONG,
                 year: str = "year", value: str = "value") -> DataFrame:
    """n, mean and sample variance by series and labelled period; periods with fewer than two values are left out."""
    labelled = label_periods(panel.where(F.col(value).isNotNull()), periods, year)
    return labelled.groupBy(*series, "period").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).where("n >= 2")


def anova(stats: DataFrame, series: Sequence[str] = LONG, alpha: float = 0.05) -> DataFrame:
    """One-way ANOVA from per-period statistics."""
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    sums = stats.groupBy(*series).agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), (F.sum(n * mean) / F.sum(n)).alias("grand"),
        F.sum(n * mean * mean).alias("raw"), F.sum((n - 1) * var).alias("within")).where("k >= 2")
    between = F.greatest(F.col("raw") - F.col("total") * F.col("grand") * F.col("grand"), F.lit(0.0))
    f = ratio(between / (F.col("k") - 1), F.col("within") / F.when(F.col("total") > F.col("k"), F.col("total") - F.col("k")))
    out = sums.withColumn("f", f)
    p = f_p_value(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("total") - F.col("k")).cast("double"))
    return out.withColumn("p_value", rounded(p, 6)).select(
        *series, F.col("k").alias("n_periods"), rounded("f", 4).alias("f_statistic"), "p_value",
        (F.col("p_value") < alpha).alias("significant"))


def period_pairs(stats: DataFrame, names: Sequence[str], series: Sequence[str] = LONG, alpha: float = 0.05) -> DataFrame:
    """Welch t-test, Bonferroni p and Cohen's d for every pair of periods (a fixed, short list of names)."""
    one = stats.groupBy(*series).agg(F.count("*").alias("k"), *[
        F.max(F.when(F.col("period") == name, F.struct("n", "mean", "var"))).alias(f"s{i}") for i, name in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(names[i]).alias("period_a"), F.lit(names[j]).alias("period_b"), F.col(f"s{i}").alias("x"),
                               F.col(f"s{j}").alias("y")) for i in range(len(names)) for j in range(i + 1, len(names))])
    rows = one.select(*series, "k", pairs.alias("_p")).select(*series, "k", F.inline("_p")).where("x is not null and y is not null")
    ex, ey = F.col("x.var") / F.col("x.n"), F.col("y.var") / F.col("y.n")
    gap = F.col("x.mean") - F.col("y.mean")
    t = ratio(gap, F.sqrt(ex + ey))
    df = ratio((ex + ey) * (ex + ey), ex * ex / (F.col("x.n") - 1) + ey * ey / (F.col("y.n") - 1))
    pooled = F.sqrt((F.col("x.var") + F.col("y.var")) / 2)
    tests = F.col("k") * (F.col("k") - 1) / 2
    out = rows.withColumn("t", t).withColumn("_p", t_p_value(F.col("t"), df))
    return out.select(
        *series, "period_a", "period_b", rounded("t", 4).alias("t_statistic"), rounded("_p", 6).alias("p_value"),
        rounded(F.least(F.col("_p") * tests, F.when(F.col("_p").isNotNull(), F.lit(1.0))), 6).alias("p_value_bonferroni"),
        (F.col("_p") < alpha).alias("significant_nominal"), (F.col("_p") < alpha / tests).alias("significant"),
        rounded(F.when(pooled > 1e-12, gap / pooled).otherwise(0.0), 3).alias("cohens_d"), rounded(gap, 4).alias("mean_diff"))


def break_test(panel: DataFrame, breaks: Sequence[tuple[str, int]], series: Sequence[str] = LONG, period: str = "year",
               value: str = "value", alpha: float = 0.05) -> DataFrame:
    """Chow test at given years, at least three observations away from both ends.

    One aggregation holds the pooled fit and both halves of every break; no fit is repeated.
    """
    known = panel.where(F.col(value).isNotNull()).withColumn("_t", (F.row_number().over(by_series(series, period)) - 1).cast("double"))
    aggregates = [moments(value, "_t").alias("m")]
    for label, at in breaks:
        left = F.when(F.col(period) < at, F.col(value))
        right = F.when(F.col(period) >= at, F.col(value))
        aggregates += [moments(left, "_t").alias(f"l_{label}"), moments(right, "_t").alias(f"r_{label}")]
    m = known.groupBy(*series).agg(*aggregates)

    def rss(c: str) -> Column:
        return F.greatest(F.col(f"{c}.syy") - F.col(f"{c}.sxy") * F.col(f"{c}.sxy") / F.when(F.col(f"{c}.sxx") > 0, F.col(f"{c}.sxx")), F.lit(0.0))

    rows = F.array(*[F.struct(
        F.lit(label).alias("break_label"), F.col("m.n").alias("n"), F.col(f"l_{label}.n").alias("n_before"),
        F.col(f"r_{label}.n").alias("n_after"), rss("m").alias("pooled"), (rss(f"l_{label}") + rss(f"r_{label}")).alias("split"))
        for label, _ in breaks])
    out = m.select(*series, rows.alias("_rows")).select(*series, F.inline("_rows"))
    tested = (F.col("n_before") >= 3) & (F.col("n_after") >= 3) & (F.col("n") > 4) & (F.col("split") > 0)
    f = F.when(tested, (F.col("pooled") - F.col("split")) / 2 / (F.col("split") / (F.col("n") - 4)))
    out = out.withColumn("f", f)
    p = f_p_value(F.col("f"), F.when(F.col("f").isNotNull(), F.lit(2.0)), (F.col("n") - 4).cast("double"))
    return out.withColumn("p_value", rounded(p, 6)).select(
        *series, "break_label", "n", rounded("f", 4).alias("f_statistic"), "p_value", (F.col("p_value") < alpha).alias("significant"),
        rounded(F.when(tested, F.col("pooled")), 4).alias("rss_full"), rounded(F.when(tested, F.col("split")), 4).alias("rss_split"))


# ---- lead and lag -------------------------------------------------------------------------------------------------

def lag_correlations(wide: DataFrame, cause: str, effect: str, lags: Sequence[int], series: Sequence[str] = ("entity",),
                     period: str = "period_start") -> DataFrame:
    """Moments of (cause k rows earlier, effect) for every lag in one aggregation: ``series, lag, m``."""
    pairs = wide.where(F.col(cause).isNotNull() & F.col(effect).isNotNull())
    shifted = pairs.withColumns({f"_c{k}": lagged(cause, k, series, period) if k else F.col(cause) for k in lags})
    m = shifted.groupBy(*series).agg(F.count("*").alias("n_all"), *[moments(effect, f"_c{k}").alias(f"m{k}") for k in lags])
    rows = F.array(*[F.struct(F.lit(int(k)).alias("lag"), F.col(f"m{k}").alias("m")) for k in lags])
    return m.select(*series, "n_all", rows.alias("_rows")).select(*series, "n_all", F.inline("_rows"))


def lead_lag(wide: DataFrame, cause: str, effect: str, max_lag: int = 12, series: Sequence[str] = ("entity",),
             period: str = "period_start", alpha: float = 0.05) -> DataFrame:
    """Lagged-correlation test at lags 1..max_lag with Bonferroni correction; ``is_best`` marks the strongest significant lag."""
    rows = lag_correlations(wide, cause, effect, list(range(1, max_lag + 1)), series, period)
    tested = F.when(F.col("n_all") < max_lag + 5, F.greatest(F.lit(1), F.col("n_all") - 5)).otherwise(max_lag)
    kept = rows.withColumn("n_lags", tested.cast("int")).where((F.col("lag") <= F.col("n_lags")) & (F.col("m.n") >= 4))
    r, n = pearson(F.col("m"), 4), F.col("m.n")
    p = kept.withColumn("_r", r).withColumn("_p", t_p_value(correlation_t(F.col("_r"), n), (n - 2).cast("double")))
    hit = F.col("_p") < alpha / F.col("n_lags")
    best = F.max(F.when(hit, F.struct(F.abs("_r").alias("size"), (-F.col("lag")).alias("first")))).over(Window.partitionBy(*series))
    return p.select(
        *series, "lag", n.alias("n_obs"), rounded("_r", 4).alias("correlation"), rounded("_p", 6).alias("p_value"),
        rounded(F.least(F.col("_p") * F.col("n_lags"), F.when(F.col("_p").isNotNull(), F.lit(1.0))), 6).alias("p_value_bonferroni"),
        F.coalesce(hit, F.lit(False)).alias("significant"), F.coalesce(-best["first"] == F.col("lag"), F.lit(False)).alias("is_best"))


def best_lag(correlated: DataFrame, series: Sequence[str] = ("entity",), alpha: float = 0.05) -> DataFrame:
    """Strongest significant lag per series, null when none is significant."""
    size = F.when(F.col("p_value") < alpha, F.abs("r"))
    return correlated.groupBy(*series).agg(F.max_by("lag", size).alias("optimal_lag"), F.max_by("r", size).alias("optimal_r"),
                                           F.max_by("p_value", size).alias("optimal_p_value"))


# ---- unit root ----------------------------------------------------------------------------------------------------

# Critical values with a constant and no trend, for n >= 50 and for shorter series.
ADF_CRITICAL = {"long": {"1%": -3.43, "5%": -2.86, "10%": -2.57}, "short": {"1%": -3.58, "5%": -2.93, "10%": -2.60}}


def _augmented(level: Column, n: Column, swept: Column, lags: Column) -> Column:
    """t statistic of the lagged level in a regression on a constant, the level and ``lags`` lagged changes; null where a regressor is redundant."""
    full = F.size(F.filter(swept["used"], lambda u: u)) == lags + 2
    variance = residual_square(swept, 6) / F.greatest(n - lags - 2, F.lit(1))
    err = F.sqrt(F.greatest(variance * swept["a"][1][1], F.lit(0.0)))
    return F.when(full, F.coalesce(level / F.when(err > 0, err), F.lit(0.0)))


def unit_root(panel: DataFrame, series: Sequence[str] = LONG, period: str = "period_start", value: str = "value",
              min_n: int = 8, max_lag: int = 4) -> DataFrame:
    """Augmented Dickey-Fuller test of every series: changes on a constant, the level before and up to four lagged changes.

    One aggregation sums the Gram matrix of all regressors over standardized values, which leaves the statistic as it is. Where the lagged changes are redundant the
    test has none; where the level is constant, and for series of fewer than ``min_n`` values, the statistic is null.
    """
    order = by_series(series, period)
    known = panel.where(F.col(value).isNotNull()).select(*series, period, F.col(value).cast("double").alias(value))
    z = standardized(known, value, series).withColumn("_t", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*series)))
    z = z.withColumns({f"_z{k}": F.lag("z", k).over(order) for k in range(1, max_lag + 2)}).withColumn("_k", F.least(F.lit(max_lag), F.floor((F.col("_n") - 1) / 4)).cast("int"))
    change = F.col("z") - F.col("_z1")
    lagged_changes = [F.when(F.col("_k") >= j, F.col(f"_z{j}") - F.col(f"_z{j + 1}")) for j in range(1, max_lag + 1)]
    sums = z.groupBy(*series).agg(
        F.max("_n").alias("n"), F.max("_k").alias("k"), moments(change, F.col("_z1")).alias("m"),
        gram([F.lit(1.0), F.col("_z1"), *lagged_changes, change], F.col("_t") > F.col("_k")).alias("g"))
    solved = sums.withColumn("s", sweep(F.col("g"), max_lag + 2))
    n, sxx, syy, sxy = (F.col(f"m.{c}") for c in ("n", "sxx", "syy", "sxy"))
    varying = F.when(sxx > TOLERANCE * n, sxx)
    slope = sxy / varying
    plain_err = F.sqrt(F.greatest(syy - slope * sxy, F.lit(0.0)) / F.greatest(n - 2, F.lit(1)) / varying)
    plain = F.coalesce(slope / F.when(plain_err > 0, plain_err), F.when(slope.isNotNull(), 0.0))
    solved = solved.withColumn("_a", _augmented(coefficient(F.col("s"), 1, 6), F.col("n") - 1 - F.col("k"), F.col("s"), F.col("k"))).withColumn("_b", plain)
    enough = F.col("n") >= min_n
    fitted = solved.select(*series, F.when(~enough, F.col("n")).when(F.col("_a").isNotNull(), F.col("n") - 1 - F.col("k")).otherwise(F.col("n") - 1).alias("n_obs"),
                           F.when(enough, F.coalesce("_a", "_b")).alias("stat"))
    stat, short, long_ = F.col("stat"), ADF_CRITICAL["short"], ADF_CRITICAL["long"]

    def critical(level: str) -> Column:
        return F.when(F.col("n_obs") < 50, short[level]).otherwise(long_[level])

    p = (F.when(stat < critical("1%"), 0.005).when(stat < critical("5%"), 0.03).when(stat < critical("10%"), 0.07)
         .when(stat.isNotNull(), 0.15 + 0.05 * F.least(F.greatest(stat + 2.57, F.lit(0.0)), F.lit(5.0))))
    return fitted.select(*series, "n_obs", rounded(stat, 4).alias("adf_statistic"), rounded(p, 4).alias("p_value"),
                         (stat < critical("5%")).alias("is_stationary"))


# ---- regression line and decomposition ----------------------------------------------------------------------------

def regression_band(wide: DataFrame, x: str, y: str, points: int = 100, level: float = 0.95, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Fitted line of y on x over an even grid, with the confidence band of the mean."""
    known = wide.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = known.groupBy(*by).agg(moments(y, x).alias("m"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"),
                                 F.avg(x).alias("mx"), F.min(x).alias("low"), F.max(x).alias("high")).where("m.n >= 3 and m.sxx > 0")
    n, sxx, syy, sxy = (F.col(f"m.{c}") for c in ("n", "sxx", "syy", "sxy"))
    sigma = F.sqrt(F.greatest(syy - sxy * sxy / sxx, F.lit(0.0)) / (n - 2))
    fit = fit.withColumn("_sigma", sigma).withColumn("_t", t_two_sided_quantile(level, n - 2))
    grid = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (points - 1))
    err = F.col("_sigma") * F.sqrt(1.0 / n + (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) / sxx)
    line = F.col("a") + F.col("b") * F.col("x")
    return grid.select(*by, "i", rounded("x", 4).alias("x"), rounded(line, 4).alias("fitted"), rounded(err, 4).alias("std_err_fit"),
                       rounded(line - F.col("_t") * err, 4).alias("band_low"), rounded(line + F.col("_t") * err, 4).alias("band_high"))


def decompose(panel: DataFrame, cycle: int, series: Sequence[str] = LONG, period: str = "period_start", value: str = "value") -> DataFrame:
    """Additive split into trend, seasonal and residual; the parts sum to the observed value.

    Trend is the centred moving average (half weights at the ends for an even cycle, the nearest known trend at the
    borders); seasonal is the mean detrended value of each phase, centred to sum to zero over a cycle. Series shorter
    than two cycles plus one are left out.
    """
    order = by_series(series, period)
    base = panel.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(*series))).where(
        F.col("_n") >= 2 * cycle + 1).withColumn("_t", F.row_number().over(order) - 1)
    half = cycle // 2
    inner = F.sum(value).over(order.rowsBetween(-half, half))
    if cycle % 2 == 0:
        ends = F.lag(value, half).over(order) + F.lead(value, half).over(order)
        middle = (inner - ends / 2) / cycle
    else:
        middle = inner / cycle
    inside = (F.col("_t") >= half) & (F.col("_t") < F.col("_n") - half)
    trended = base.withColumn("_m", F.when(inside, middle))
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    trended = trended.withColumn("trend", F.coalesce(F.last("_m", True).over(back), F.first("_m", True).over(ahead)))
    phase = Window.partitionBy(*series, "_phase")
    detrended = trended.withColumn("_phase", F.col("_t") % cycle).withColumn("_d", F.when(inside, F.col(value) - F.col("trend")))
    seasonal = detrended.withColumn("_s", F.avg("_d").over(phase))
    one_cycle = F.avg(F.when(F.col("_t") < cycle, F.col("_s"))).over(Window.partitionBy(*series))
    out = seasonal.withColumn("seasonal", F.col("_s") - one_cycle)
    return out.select(*series, period, F.col(value).alias("observed"), "trend", "seasonal",
                      (F.col(value) - F.col("trend") - F.col("seasonal")).alias("residual"))
