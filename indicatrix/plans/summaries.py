"""Summary operators on the stand-in economies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from indicatrix.functions.numeric import as_cents, rounded
from indicatrix.operators import summaries as sm
from indicatrix.plans.economy import Warehouse, economy, table, to_panel
from indicatrix.plans.statistics import PRIMARY, annual_panel
from indicatrix.registry import PILLARS

INDICATORS = [c for p in PILLARS.values() for c in p.columns if c not in ("gdp_growth_qoq", "budget_deficit_annual")]
DERIVED = ["youth_gap", "core_headline_gap", "real_rate"]


def full_panel(wh: Warehouse) -> DataFrame:
    """Every indicator at its own grain, with the derived gaps, long."""
    wide = wh.mixed.withColumns({
        "youth_gap": F.col("youth_unemployment_rate") - F.col("unemployment_rate"),
        "core_headline_gap": F.col("hicp") - F.col("core_inflation"),
        "real_rate": F.col("ecb_main_refinancing_rate") - F.col("hicp")})
    return to_panel(wide, INDICATORS + DERIVED).where("value is not null")


def pillar_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive statistics of every indicator and gap of all six pillars, in one job."""
    return sm.describe(full_panel(economy(spark, sf_dir)))


def annual_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of annual means and of their growth."""
    grown = sm.with_growth(annual_panel(economy(spark, sf_dir)))
    both = grown.unpivot(["entity", "indicator", "year"], ["value", "growth_pct"], "measure", "x").where("x is not null")
    return sm.describe(both, by=("entity", "indicator", "measure"), value="x")


def half_split_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.half_split(annual_panel(economy(spark, sf_dir)))


def crisis_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = economy(spark, sf_dir)
    return sm.crisis_summary(annual_panel(wh), wh.crisis_windows)


def inflation_regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.regimes(economy(spark, sf_dir).monthly, value="hicp")


def peaks_and_troughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = to_panel(economy(spark, sf_dir).monthly, ["unemployment_rate", "hicp", "total_credit"]).where("value is not null")
    late = F.datediff("period_start", F.lit("1970-01-01"))
    return monthly.groupBy("entity", "indicator").agg(
        F.max("value").alias("peak"), F.max_by("period_start", F.struct("value", -late)).alias("peak_at"),
        F.min("value").alias("trough"), F.min_by("period_start", F.struct(F.col("value"), late)).alias("trough_at"))


def pillar_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = economy(spark, sf_dir)
    out = sm.summarise(to_panel(wh.mixed, PRIMARY).where("value is not null"), wh.crisis_windows)
    numbers = ["earliest_value", "latest_value", "mean", "std", "peak_value", "trough_value", "pct_shift_halves", "overall_change_pct",
               "latest_growth", "recent_avg_growth", "longrun_avg_growth", "momentum_gap"]
    return out.select("entity", "indicator", "earliest_year", "latest_year", "peak_year", "trough_year", "trend",
                      *[rounded(c, 4).alias(c) for c in numbers])


def crisis_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = economy(spark, sf_dir)
    out = sm.summarise(to_panel(wh.mixed, PRIMARY).where("value is not null"), wh.crisis_windows)
    return out.select("entity", "indicator", F.inline("crisis_impacts")).select(
        "entity", "indicator", "label", *[rounded(c, 4).alias(c) for c in ("mean_value", "mean_growth", "min_value", "max_value")])


def latest_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.latest_report(full_panel(economy(spark, sf_dir)))


def latest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest non-null value per indicator, also where the newest period is missing."""
    panel = to_panel(economy(spark, sf_dir).monthly.withColumn("npl_ratio", F.when(F.year("period_start") < 2001, F.col("npl_ratio"))),
                     ["unemployment_rate", "npl_ratio", "hicp"])
    known = panel.where("value is not null")
    return known.groupBy("entity", "indicator").agg(F.max("period_start").alias("period_start"), F.max_by("value", "period_start").alias("value"))


def annual_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual means of one indicator per pillar, complete years only."""
    wide = economy(spark, sf_dir).mixed.groupBy("entity", F.year("period_start").alias("year")).agg(
        *[rounded(F.avg(c), 4).alias(c) for c in [*PRIMARY, "gdp_growth_yoy"]])
    return wide.dropna()


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.null_report(economy(spark, sf_dir).monthly, [c for p in PILLARS.values() if p.grain == "month" for c in p.columns], by=("entity",))


def duplicate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once: a customer ordering twice on a day."""
    return sm.duplicate_keys(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")), ["o_custkey", "day"])


def annualised_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = sm.last_n(economy(spark, sf_dir).quarterly.select("entity", "period_start", "nominal_gdp"), 4, by=("entity",))
    return last.groupBy("entity").agg(F.count("*").alias("quarters"), rounded(F.sum("nominal_gdp")).alias("annual_nominal_gdp"))


def quarter_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months to quarter means, and the change from quarter to quarter."""
    q = economy(spark, sf_dir).monthly.groupBy("entity", F.trunc("period_start", "quarter").alias("period_start")).agg(
        F.avg("unemployment_rate").alias("u"), F.count("*").alias("months"))
    order = Window.partitionBy("entity").orderBy("period_start")
    return q.select("entity", "period_start", "months", rounded("u", 4).alias("mean_rate"), rounded(F.col("u") - F.lag("u").over(order), 4).alias("rate_change"))


def last_36_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = economy(spark, sf_dir).monthly.select("entity", "period_start", "total_credit")
    return sm.last_n(monthly, 36, by=("entity",))


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per priority over single orders: groups grow with the orders, so the median is found by rank over counts of values."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", as_cents("o_totalprice").cast("double").alias("value"))
    return sm.describe_large(orders, by=("o_orderpriority",))


QUERIES = {f.__name__: f for f in (
    pillar_statistics, annual_statistics, half_split_trends, crisis_window_stats, inflation_regime_counts, peaks_and_troughs,
    pillar_summaries, crisis_impacts, latest_indicators, latest_known, annual_matrix, null_counts, duplicate_orders, annualised_output,
    quarter_means, last_36_months, order_statistics)}
