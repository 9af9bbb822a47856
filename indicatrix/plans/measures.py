"""Report measures: each a table over entity and period instead of a formula over a filter context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from indicatrix.functions.bands import band
from indicatrix.functions.keys import month_index, period_key, year_month_label, year_quarter_label
from indicatrix.functions.numeric import ratio, rounded
from indicatrix.operators.joins import period_label
from indicatrix.operators.windows import calendar_average, fill
from indicatrix.plans.economy import economy

POLICY, BOND = "ecb_main_refinancing_rate", "portugal_10y_bond_yield"
# measure, indicator, divisor
LATEST = [
    ("latest_gdp", "nominal_gdp", 1), ("latest_gdp_growth", "gdp_growth_yoy", 100), ("latest_gdp_per_capita", "gdp_per_capita", 1),
    ("latest_unemployment", "unemployment_rate", 1), ("latest_youth_unemployment", "youth_unemployment_rate", 1), ("latest_hicp", "hicp", 100),
    ("latest_debt_to_gdp", "debt_to_gdp_ratio", 100), ("latest_ecb_rate", POLICY, 100), ("latest_euribor_12m", "euribor_12m", 100),
    ("latest_10y_bond", BOND, 100), ("latest_total_credit", "total_credit", 1), ("latest_npl_ratio", "npl_ratio", 100),
    ("latest_budget_balance", "budget_deficit", 100)]
# measure, indicator, "pct" or "pp"
YOY = [("gdp_yoy_growth", "nominal_gdp", "pct"), ("unemployment_yoy_change", "unemployment_rate", "pp"), ("credit_yoy_growth", "total_credit", "pct"),
       ("euribor_12m_yoy_change", "euribor_12m", "pp"), ("hicp_yoy_change", "hicp", "pp"), ("debt_to_gdp_yoy_change", "debt_to_gdp_ratio", "pp")]
AVERAGES = [("unemployment_3m_ma", "unemployment_rate", 3), ("unemployment_12m_ma", "unemployment_rate", 12), ("hicp_3m_ma", "hicp", 3), ("hicp_12m_ma", "hicp", 12),
            ("credit_3m_ma", "total_credit", 3), ("euribor_12m_3m_ma", "euribor_12m", 3)]
# Traffic lights.
LIGHTS = {
    "gdp_growth": ([(">", 2, "Green"), (">=", 0, "Amber")], "Red"), "unemployment": ([("<", 7, "Green"), ("<=", 10, "Amber")], "Red"),
    "inflation": ([("<", 0, "Red"), ("<", 1, "Amber"), ("<=", 3, "Green"), ("<=", 5, "Amber")], "Red"),
    "debt_to_gdp": ([("<", 60, "Green"), ("<=", 100, "Amber")], "Red"), "npl_ratio": ([("<", 3, "Green"), ("<=", 5, "Amber")], "Red"),
    "sovereign_spread": ([("<", 100, "Green"), ("<=", 300, "Amber")], "Red")}
UP, DOWN, FLAT = "▲", "▼", "►"


def _year_before(c: str) -> Column:
    at = Window.partitionBy("entity", "grain").orderBy(month_index(F.col("period_start"))).rangeBetween(-12, -12)
    return F.max(c).over(at)


def _latest(c: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period_start"))).alias(c)


def kpi_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = economy(spark, sf_dir).mixed.groupBy("entity").agg(*[_latest(c) for _, c, _ in LATEST])
    return wide.select("entity", *[rounded(F.col(c) / d, 6).alias(name) for name, c, d in LATEST])


def _yoy(mixed: DataFrame) -> DataFrame:
    def measure(c: str, kind: str) -> Column:
        now, before = F.col(c), _year_before(c)
        return now - before if kind == "pp" else ratio(now - before, before)
    return mixed.select("entity", "grain", "period_start", "date_key", "hicp", "gdp_growth_yoy", POLICY, *[measure(c, k).alias(name) for name, c, k in YOY])


def kpi_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same period last year by date."""
    wide = _yoy(economy(spark, sf_dir).mixed)
    long = wide.unpivot(["entity", "date_key"], [name for name, _, _ in YOY], "measure", "value").where("value is not null")
    return long.withColumn("value", rounded("value", 6))


def kpi_moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = economy(spark, sf_dir).monthly
    return monthly.select("entity", "date_key", *[rounded(calendar_average(c, k), 4).alias(name) for name, c, k in AVERAGES])


def kpi_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread in basis points, real rate (the last known values where a month is missing one), youth gap."""
    m = economy(spark, sf_dir).monthly
    return m.select("entity", "date_key", rounded((F.col(BOND) - F.col(POLICY)) * 100).alias("sovereign_spread_bps"),
                    rounded((fill(POLICY) - fill("hicp")) / 100, 6).alias("real_interest_rate"),
                    rounded(F.col("youth_unemployment_rate") - F.col("unemployment_rate")).alias("youth_unemployment_gap"))


def kpi_credit_to_gdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean credit of the quarter over annualised output."""
    by_quarter = economy(spark, sf_dir).mixed.groupBy("entity", F.trunc("period_start", "quarter").alias("q")).agg(
        F.avg("total_credit").alias("credit"), F.max("nominal_gdp").alias("gdp"), F.max("gdp_per_capita").alias("per_capita"))
    return by_quarter.where("gdp is not null").select("entity", period_key(F.col("q"), "quarter").alias("date_key"),
                                                      rounded(ratio("credit", F.col("gdp") * 4), 6).alias("credit_to_gdp_ratio"), rounded("per_capita").alias("avg_gdp_per_capita"))


def kpi_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = economy(spark, sf_dir)
    labelled = wh.mixed.withColumn("economic_period", period_label(F.year("period_start"), wh.periods))
    return labelled.groupBy("entity", "economic_period").agg(
        rounded(F.avg("unemployment_rate"), 4).alias("avg_unemployment"), rounded(F.avg("gdp_growth_yoy") / 100, 6).alias("period_gdp_growth"),
        rounded(F.avg("budget_deficit") / 100, 6).alias("avg_budget_balance"))


def _arrow(change: Column, limit: float) -> Column:
    return F.when(change > limit, UP).when(change < -limit, DOWN).otherwise(FLAT)


def trend_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of six indicators at the newest period against a year before."""
    mixed = economy(spark, sf_dir).mixed
    yoy = _yoy(mixed).withColumns({"gdp_change": F.col("gdp_growth_yoy") - _year_before("gdp_growth_yoy"), "policy_change": F.col(POLICY) - _year_before(POLICY)})
    def newest(c: str, grain: str) -> Column:
        return F.max_by(c, F.when(F.col("grain") == grain, F.col("period_start"))).alias(c)
    one = yoy.groupBy("entity").agg(newest("gdp_change", "quarter"), newest("debt_to_gdp_yoy_change", "quarter"), newest("unemployment_yoy_change", "month"),
                                    newest("hicp", "month"), newest("hicp_yoy_change", "month"), newest("credit_yoy_growth", "month"), newest("policy_change", "month"))
    hicp, move = F.col("hicp"), F.col("hicp_yoy_change")
    inflation = (F.when(hicp.isNull() | (F.abs(hicp - 2) <= 0.5), FLAT).when((hicp > 2) & (move < 0), DOWN).when((hicp < 2) & (move > 0), UP)
                 .when(move > 0, UP).otherwise(DOWN))
    return one.select("entity", _arrow(F.col("gdp_change"), 0.5).alias("gdp_growth"), _arrow(F.col("unemployment_yoy_change"), 0.3).alias("unemployment"),
                      inflation.alias("inflation"), _arrow(F.col("credit_yoy_growth"), 0.01).alias("credit"), _arrow(F.col("policy_change"), 0.1).alias("ecb_rate"),
                      _arrow(F.col("debt_to_gdp_yoy_change"), 1.0).alias("debt"))


def traffic_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = economy(spark, sf_dir).mixed.groupBy("entity").agg(*[_latest(c) for c in ("gdp_growth_yoy", "unemployment_rate", "hicp", "debt_to_gdp_ratio", "npl_ratio", BOND, POLICY)])
    values = {"gdp_growth": F.col("gdp_growth_yoy"), "unemployment": F.col("unemployment_rate"), "inflation": F.col("hicp"), "debt_to_gdp": F.col("debt_to_gdp_ratio"),
              "npl_ratio": F.col("npl_ratio"), "sovereign_spread": (F.col(BOND) - F.col(POLICY)) * 100}
    return one.select("entity", *[band(v, LIGHTS[k]).alias(k) for k, v in values.items()])


def calendar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period, its sort order and display labels of every period there is a fact for."""
    wh = economy(spark, sf_dir)
    start = F.col("period_start")
    names = [p[0] for p in wh.periods]
    label = period_label(F.year(start), wh.periods)
    order = F.coalesce(*[F.when(label == n, i + 1) for i, n in enumerate(names)])
    return wh.mixed.groupBy("grain", "period_start", "date_key").agg(F.count("*").alias("n_entities")).select(
        "grain", "date_key", "n_entities", label.alias("economic_period"), order.alias("period_sort_order"), year_quarter_label(start).alias("year_quarter"),
        F.when(F.col("grain") == "month", year_month_label(start)).alias("year_month"))


QUERIES = {f.__name__: f for f in (kpi_latest, kpi_yoy, kpi_moving_averages, kpi_derived, kpi_credit_to_gdp, kpi_by_period, trend_arrows, traffic_lights, calendar_columns)}
