"""Tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from indicatrix.functions.bands import band
from indicatrix.functions.numeric import minmax_score, rounded
from indicatrix.operators.joins import densify, periods_table
from indicatrix.operators.statistics import pair_correlations
from indicatrix.operators.windows import interpolate, trailing, whole_series
from indicatrix.plans.economy import economy, to_panel

POLICY, BOND = "ecb_main_refinancing_rate", "portugal_10y_bond_yield"
PANELS = ["nominal_gdp", "unemployment_rate", "total_credit", BOND, "hicp", "debt_to_gdp_ratio"]
TIMELINE = ["unemployment_rate", "hicp", POLICY, "npl_ratio"]
MATRIX = ["real_gdp", "unemployment_rate", "total_credit", "npl_ratio", POLICY, "hicp", "debt_to_gdp_ratio", "budget_deficit"]


def chart_annual_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economy(spark, sf_dir).quarterly.groupBy("entity", F.year("period_start").alias("year")).agg(
        rounded(F.sum("nominal_gdp")).alias("annual_gdp"), rounded(F.avg("gdp_growth_yoy"), 4).alias("mean_growth"))


def chart_unemployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economy(spark, sf_dir).monthly.select("entity", "period_start", "unemployment_rate", "youth_unemployment_rate", "long_term_unemployment_rate",
                                                 rounded(trailing("unemployment_rate", 12, min_obs=6), 4).alias("ma12"))


def chart_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economy(spark, sf_dir).monthly.select("entity", "period_start", "credit_nfc", "credit_households", "npl_ratio")


def chart_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economy(spark, sf_dir).monthly.select("entity", "period_start", POLICY, "euribor_3m", "euribor_6m", "euribor_12m", BOND)


def chart_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline and core with the annual mean and a band around the target."""
    yearly = Window.partitionBy("entity", F.year("period_start"))
    return economy(spark, sf_dir).monthly.select(
        "entity", "period_start", "hicp", "core_inflation", rounded(F.avg("hicp").over(yearly), 4).alias("annual_mean"),
        band("hicp", ([("<", 0, "negative"), ("<", 1, "below"), ("<=", 3, "near target")], "above"), null_label=None).alias("position"))


def chart_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economy(spark, sf_dir).quarterly.select("entity", "period_start", "debt_to_gdp_ratio", "budget_deficit", "total_debt")


def chart_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight indicators on quarters: monthly ones averaged, quarterly ones as they are."""
    wide = economy(spark, sf_dir).mixed.groupBy("entity", F.trunc("period_start", "quarter").alias("period_start")).agg(*[F.avg(c).alias(c) for c in MATRIX])
    return pair_correlations(wide, MATRIX).select("entity", "a", "b", "n", "r")


def chart_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value of each panel and its change against 12 observations back, or the first."""
    panel = to_panel(economy(spark, sf_dir).mixed, PANELS).where("value is not null")
    back = F.row_number().over(Window.partitionBy("entity", "indicator").orderBy(F.desc("period_start")))
    one = panel.withColumn("k", back).groupBy("entity", "indicator").agg(
        F.max(F.when(F.col("k") == 1, F.col("value"))).alias("latest"), F.max("period_start").alias("latest_at"),
        F.coalesce(F.max(F.when(F.col("k") == 13, F.col("value"))), F.min_by("value", "period_start")).alias("_before"))
    return one.select("entity", "indicator", "latest_at", rounded("latest", 4).alias("latest"), rounded(F.col("latest") - F.col("_before"), 4).alias("change"))


def chart_phillips_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = economy(spark, sf_dir).monthly.dropna(subset=["unemployment_rate", "hicp"])
    return both.groupBy("entity", F.year("period_start").alias("year")).agg(
        F.count("*").alias("n"), rounded(F.avg("unemployment_rate"), 4).alias("x"), rounded(F.avg("hicp"), 4).alias("y"))


def chart_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators on a common 0-100 scale."""
    whole = whole_series()
    monthly = economy(spark, sf_dir).monthly
    return monthly.select("entity", "period_start", *[rounded(minmax_score(F.col(c), F.min(c).over(whole), F.max(c).over(whole)), 2).alias(c) for c in TIMELINE])


def chart_growth_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly growth interpolated to months and scaled 0-100."""
    q = economy(spark, sf_dir).quarterly.where("gdp_growth_yoy is not null").select("entity", "period_start", F.col("gdp_growth_yoy").alias("value"))
    monthly = densify(q, grain="month").withColumn("value", interpolate("value"))
    whole = whole_series()
    return monthly.select("entity", "period_start", rounded("value", 4).alias("growth"),
                          rounded(minmax_score(F.col("value"), F.min("value").over(whole), F.max("value").over(whole)), 2).alias("scaled"))


def chart_shading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled windows clipped to each entity's data range; windows outside it are left out."""
    wh = economy(spark, sf_dir)
    span = wh.monthly.groupBy("entity").agg(F.min("period_start").alias("first"), F.max("period_start").alias("last"))
    start, end = F.make_date("first_year", F.lit(1), F.lit(1)), F.make_date("last_year", F.lit(12), F.lit(31))
    joined = span.join(periods_table(spark, wh.crisis_windows), (start <= F.col("last")) & (end >= F.col("first")))
    return joined.select("entity", "period", F.greatest(start, F.col("first")).alias("shade_from"), F.least(end, F.col("last")).alias("shade_to"))


QUERIES = {f.__name__: f for f in (chart_annual_output, chart_unemployment, chart_credit, chart_rates, chart_inflation, chart_debt, chart_correlations,
                                   chart_panels, chart_phillips_means, chart_timeline, chart_growth_monthly, chart_shading)}
