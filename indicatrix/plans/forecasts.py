"""Forecasts and backtests on the stand-in economies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from indicatrix.functions.keys import period_key
from indicatrix.functions.numeric import rounded
from indicatrix.operators import forecast as fc
from indicatrix.operators.summaries import last_n
from indicatrix.plans.economy import Warehouse, economy, to_panel

REVERTING = ["unemployment_rate", "ecb_main_refinancing_rate", "hicp"]


def _round(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in fc.BANDS})


def _monthly(wh: Warehouse, *columns: str) -> DataFrame:
    return to_panel(wh.monthly, list(columns)).where("value is not null")


def _quarterly(wh: Warehouse, *columns: str) -> DataFrame:
    return to_panel(wh.quarterly, list(columns)).where("value is not null")


def gdp_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fc.log_linear(_quarterly(economy(spark, sf_dir), "real_gdp"), 8, "quarter")
    return _round(out).withColumn("date_key", period_key(F.col("period_start"), "quarter"))


def credit_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log trend of the last 36 months."""
    out = fc.log_linear(last_n(_monthly(economy(spark, sf_dir), "total_credit"), 36), 12, "month")
    return _round(out).withColumn("date_key", period_key(F.col("period_start"), "month"))


def credit_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.log_linear_growth(last_n(_monthly(economy(spark, sf_dir), "total_credit"), 36), 12)


def rate_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy rate and 12-month rate return to their own mean."""
    return _round(fc.mean_reversion(_monthly(economy(spark, sf_dir), "ecb_main_refinancing_rate", "euribor_12m"), 12, "month"), 3)


def inflation_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fc.mean_reversion(_monthly(economy(spark, sf_dir), "hicp"), 12, "month", target=2.0))


def smoothing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [i / 20 for i in range(1, 20)]
    return fc.best_alpha(_monthly(economy(spark, sf_dir), "unemployment_rate"), grid).withColumn("sse", rounded("sse", 3))


def unemployment_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reversion of the smoothed rate towards the mean of the raw one."""
    panel = _monthly(economy(spark, sf_dir).shared("unemployment_rate"), "unemployment_rate")
    smooth = fc.smooth_with(panel, fc.best_alpha(panel, [i / 20 for i in range(1, 20)]))
    targets = panel.groupBy("entity", "indicator").agg(F.avg("value").alias("target"))
    return _round(fc.mean_reversion(smooth, 12, "month", targets=targets))


def trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fc.linear_trend(_monthly(economy(spark, sf_dir), *REVERTING), 12, "month"), 3)


def debt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debt ratio path from the latest yield, growth and balance."""
    wh = economy(spark, sf_dir)
    is_quarter = F.col("grain") == "quarter"
    order = Window.partitionBy("entity", "grain").orderBy("period_start")
    back = F.row_number().over(Window.partitionBy("entity", "grain").orderBy(F.desc("period_start")))
    rows = wh.mixed.select("entity", "grain", "period_start", "debt_to_gdp_ratio", "budget_deficit", "portugal_10y_bond_yield", back.alias("k"),
                           ((F.col("nominal_gdp") - F.lag("nominal_gdp").over(order)) / F.lag("nominal_gdp").over(order)).alias("growth"),
                           (F.col("debt_to_gdp_ratio") - F.lag("debt_to_gdp_ratio").over(order)).alias("move"))
    yield_ = F.max_by("portugal_10y_bond_yield", F.when(F.col("portugal_10y_bond_yield").isNotNull(), F.col("period_start")))
    quarter_at = F.when(is_quarter, F.col("period_start"))
    start = rows.groupBy("entity").agg(
        F.max_by("debt_to_gdp_ratio", quarter_at).alias("debt"), (F.pow(1 + yield_ / 100.0, 0.25) - 1).alias("r"),
        F.coalesce(F.avg(F.when(is_quarter & (F.col("k") <= 4), F.col("growth"))), F.lit(0.005)).alias("g"),
        (F.max_by("budget_deficit", quarter_at) / 4.0).alias("pb"), F.stddev_pop("move").alias("sigma"), F.max(quarter_at).alias("last_period"))
    return _round(fc.debt_path(start, 12))


def _gdp_backtest(wh: Warehouse) -> DataFrame:
    return fc.prefix_forecasts(_quarterly(wh, "real_gdp"), ["log_linear"], 4, fc.expanding_origins(12, 4))


def _rate_backtest(wh: Warehouse) -> DataFrame:
    return fc.prefix_forecasts(_monthly(wh, "unemployment_rate"), ["mean_reversion"], 12, fc.expanding_origins(36, 12))


def backtest_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every origin of the expanding-window backtest."""
    return fc.metrics(_gdp_backtest(economy(spark, sf_dir)), ["entity", "indicator", "model", "origin"])


def backtest_gdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.metrics(_gdp_backtest(economy(spark, sf_dir)), ["entity", "indicator", "model"])


def backtest_unemployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.metrics(_rate_backtest(economy(spark, sf_dir)), ["entity", "indicator", "model"])


def _scores(panel: DataFrame, models: list[str], cycle: int) -> DataFrame:
    return fc.prefix_forecasts(panel, models, cycle, fc.last_splits(3, cycle))


def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = fc.model_weights(_scores(_monthly(economy(spark, sf_dir), *REVERTING), ["linear", "mean_reversion"], 12))
    return weights.withColumns({"mae": rounded("mae", 4), "weight": rounded("weight", 4)})


def ensemble_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates: trend and mean reversion. Credit: trend and log trend. Weighted by their backtest errors."""
    wh = economy(spark, sf_dir).shared(*REVERTING, "total_credit")
    rates, credit = _monthly(wh, *REVERTING), _monthly(wh, "total_credit")
    weights = fc.model_weights(_scores(rates, ["linear", "mean_reversion"], 12)).unionByName(
        fc.model_weights(_scores(credit, ["linear", "log_linear"], 12)))
    runs = [("linear", fc.linear_trend(rates.unionByName(credit), 12, "month")), ("mean_reversion", fc.mean_reversion(rates, 12, "month")), ("log_linear", fc.log_linear(credit, 12, "month"))]
    stacked = None
    for name, run in runs:
        named = run.withColumn("model", F.lit(name))
        stacked = named if stacked is None else stacked.unionByName(named)
    return fc.ensemble(stacked, weights)


def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fc.holt_winters(_monthly(economy(spark, sf_dir), "unemployment_rate", "hicp"), 12, "month", 12).drop("detail"))


def order_search_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fc.autoregression(_quarterly(economy(spark, sf_dir), "real_gdp"), 8, "quarter"))


#: Indicator, grain and steps of the pillars' ensembles: a year ahead.
ENSEMBLES = [("unemployment_rate", "month", 12), ("hicp", "month", 12), ("ecb_main_refinancing_rate", "month", 12), ("total_credit", "month", 12),
             ("real_gdp", "quarter", 4), ("debt_to_gdp_ratio", "quarter", 4)]
MODELS = ["linear", "mean_reversion", "holt_winters", "autoregression"]


def _all_models(panel: DataFrame, grain: str, cycle: int) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all four models, and their backtest rows on the last three splits of a year."""
    first = [F.col("n") - k * cycle for k in (3, 2, 1)]
    splits = F.filter(F.array(*first), lambda o: o >= 12)
    scored = _scores(panel, ["linear", "mean_reversion"], cycle) \
        .unionByName(fc.split_forecasts(fc.holt_winters_fits(panel, cycle, splits, cycle), panel, "holt_winters", cycle)) \
        .unionByName(fc.split_forecasts(fc.autoregression_fits(panel, fc.last_splits(3, cycle), cycle), panel, "autoregression", cycle))
    runs = [fc.linear_trend(panel, cycle, grain).drop("n"), fc.mean_reversion(panel, cycle, grain).drop("n"), fc.holt_winters(panel, cycle, grain, cycle).drop("detail"), fc.autoregression(panel, cycle, grain).drop("detail")]
    stacked = None
    for name, run in zip(MODELS, runs):
        named = run.withColumn("model", F.lit(name))
        stacked = named if stacked is None else stacked.unionByName(named)
    return stacked, scored


def _ensembles(wh: Warehouse) -> tuple[DataFrame, DataFrame]:
    parts = []
    for grain, cycle in (("month", 12), ("quarter", 4)):
        names = [c for c, g, _ in ENSEMBLES if g == grain]
        parts.append(_all_models(_monthly(wh, *names) if grain == "month" else _quarterly(wh, *names), grain, cycle))
    return parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])


def full_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of models on the leading indicator of each of the six pillars, weighted by their errors on the last three splits."""
    forecasts, scored = _ensembles(economy(spark, sf_dir).shared(*[c for c, _, _ in ENSEMBLES]))
    return fc.ensemble(forecasts, fc.model_weights(scored))


def ensemble_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each series and model of the ensembles: origins scored, error, weight, and whether it failed."""
    _, scored = _ensembles(economy(spark, sf_dir).shared(*[c for c, _, _ in ENSEMBLES]))
    weights = fc.model_weights(scored)
    origins = scored.groupBy("entity", "indicator", "model").agg(F.count_distinct("origin").alias("origins"))
    status = F.when(F.col("mae").isNull(), "failed").otherwise("ok")
    return weights.join(origins, ["entity", "indicator", "model"]).select("entity", "indicator", "model", "origins", rounded("mae", 4).alias("mae"), rounded("weight", 4).alias("weight"), status.alias("status"))


QUERIES = {f.__name__: f for f in (
    gdp_forecast, credit_forecast, credit_growth, rate_forecast, inflation_forecast, smoothing_weights, unemployment_forecast, trend_forecast,
    debt_forecast, backtest_origins, backtest_gdp, backtest_unemployment, ensemble_weights, ensemble_forecast, seasonal_forecast,
    order_search_forecast, full_ensemble, ensemble_status)}
