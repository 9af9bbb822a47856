"""Statistical tests and correlation reports on the stand-in economies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from indicatrix.functions.numeric import pct_change, rounded
from indicatrix.operators import statistics as st
from indicatrix.operators.joins import label_periods
from indicatrix.operators.windows import by_series, lagged
from indicatrix.plans.economy import PERIODS, Warehouse, economy, to_panel
from indicatrix.registry import PILLARS

PRIMARY = ["real_gdp", "unemployment_rate", "total_credit", "ecb_main_refinancing_rate", "hicp", "debt_to_gdp_ratio"]
MONTHLY_PRIMARY = ["unemployment_rate", "total_credit", "ecb_main_refinancing_rate", "hicp"]
MATRIX = [c for p in PILLARS.values() if p.grain == "month" for c in p.columns]
BREAKS = [("early_1998", 1998), ("late_2001", 2001)]
POLICY = "ecb_main_refinancing_rate"


def annual_panel(wh: Warehouse) -> DataFrame:
    """Annual means of the six primary indicators, long."""
    wide = wh.mixed.groupBy("entity", F.year("period_start").alias("year")).agg(*[F.avg(c).alias(c) for c in PRIMARY])
    return to_panel(wide, PRIMARY, ("entity", "year")).where("value is not null")


def monthly_panel(wh: Warehouse) -> DataFrame:
    return to_panel(wh.monthly, MONTHLY_PRIMARY).where("value is not null").withColumn("year", F.year("period_start"))


def trend_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.trend_test(annual_panel(economy(spark, sf_dir)), period="year")


def trend_tests_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.trend_test(monthly_panel(economy(spark, sf_dir)))


def period_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.anova(st.period_stats(monthly_panel(economy(spark, sf_dir)), PERIODS))


def period_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.period_pairs(st.period_stats(monthly_panel(economy(spark, sf_dir)), PERIODS), [p[0] for p in PERIODS])


def structural_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.break_test(annual_panel(economy(spark, sf_dir)), BREAKS)


def lead_lag_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.lead_lag(economy(spark, sf_dir).monthly, POLICY, "total_credit", 12)


def unit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.unit_root(monthly_panel(economy(spark, sf_dir)))


def phillips_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unemployment against inflation: overall and by sub-periods, which may overlap."""
    return _phillips(economy(spark, sf_dir))


def _phillips(wh: Warehouse) -> DataFrame:
    labelled = label_periods(wh.monthly.withColumn("year", F.year("period_start")), [("overall", 0, 9999), *wh.phillips_periods])
    m = labelled.groupBy("entity", "period").agg(st.moments("hicp", "unemployment_rate").alias("m")).where("m.n >= 3")
    return st.with_correlation(m)


def _transmission(wh: Warehouse, effect: str) -> DataFrame:
    from indicatrix.operators.joins import lag_pairs

    pairs = lag_pairs(wh.monthly, POLICY, effect, [0, 3, 6, 12])
    m = pairs.groupBy("entity", "lag").agg(st.moments("effect", "cause").alias("m"))
    return st.with_correlation(m).withColumn("effect", F.lit(effect))


def rate_transmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = economy(spark, sf_dir).shared(POLICY, "total_credit", "hicp")
    return _transmission(wh, "total_credit").unionByName(_transmission(wh, "hicp"))


def rate_transmission_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.best_lag(rate_transmission(spark, sf_dir), ["entity", "effect"])


def debt_gdp_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of debt and output: growth rates, and levels for reference."""
    return _debt_gdp(economy(spark, sf_dir))


def _debt_gdp(wh: Warehouse) -> DataFrame:
    grown = wh.quarterly.select(
        "entity", "total_debt", "nominal_gdp", pct_change(F.col("total_debt"), lagged("total_debt")).alias("dg"),
        pct_change(F.col("nominal_gdp"), lagged("nominal_gdp")).alias("gg"))
    m = grown.groupBy("entity").agg(st.moments("gg", "dg").alias("g"), st.moments("nominal_gdp", "total_debt").alias("l"))
    rows = m.select("entity", F.explode(F.array(F.struct(F.lit("growth_rates").alias("method"), F.col("g").alias("m")),
                                                F.struct(F.lit("levels").alias("method"), F.col("l").alias("m")))).alias("x"))
    return st.with_correlation(rows.select("entity", "x.method", "x.m"))


def divergence_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in which debt and output move in opposite directions by more than 1 %."""
    return _divergence(economy(spark, sf_dir))


def _divergence(wh: Warehouse) -> DataFrame:
    annual = wh.quarterly.groupBy("entity", F.year("period_start").alias("year")).agg(
        F.avg("total_debt").alias("debt"), F.avg("nominal_gdp").alias("output"))
    order = by_series(period="year")
    change = annual.select("entity", "year", *[pct_change(F.col(c), F.lag(c).over(order)).alias(c) for c in ("debt", "output")])
    def direction(c):
        return F.when(F.col(c) > 1.0, "rising").when(F.col(c) < -1.0, "falling").otherwise("stable")
    opposite = ((F.col("debt") > 1.0) & (F.col("output") < -1.0)) | ((F.col("debt") < -1.0) & (F.col("output") > 1.0))
    return change.where(opposite).select("entity", "year", direction("debt").alias("debt_direction"), direction("output").alias("gdp_direction"),
                                         rounded("debt").alias("debt_change_pct"), rounded("output").alias("gdp_change_pct"))


def correlation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.pair_correlations(economy(spark, sf_dir).monthly, MATRIX)


def correlation_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.pair_correlations(st.difference_columns(economy(spark, sf_dir).monthly.select("entity", "period_start", *MATRIX), MATRIX), MATRIX)


TOTALS = {"total_credit": ["credit_nfc", "credit_households"]}


def _matrix(wh: Warehouse) -> DataFrame:
    """Pairs of stationary levels or, where a unit root is not rejected, first differences, of all monthly indicators but totals that are nearly the sum of their parts."""
    wide = wh.monthly.select("entity", "period_start", *MATRIX)
    roots = st.unit_root(to_panel(wide, MATRIX).where("value is not null"))
    pairs = st.pair_correlations(st.difference_columns(wide, MATRIX, roots), MATRIX)
    for total, parts in TOTALS.items():
        found = st.redundant_total(wide, total, parts).where("is_redundant").select("entity", F.lit(total).alias("total"))
        pairs = pairs.join(found, (pairs.entity == found.entity) & ((pairs.a == found.total) | (pairs.b == found.total)), "left_anti")
    return pairs


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(economy(spark, sf_dir).shared(*MATRIX))


def near_perfect_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = correlation_levels(spark, sf_dir).where(F.abs("r") > 0.5)
    return pairs.select("entity", "a", "b", "n", "r", (F.abs("r") > 0.95).alias("is_suspicious")).orderBy(F.desc(F.abs("r")))


def redundant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = economy(spark, sf_dir).monthly.withColumn("rest", F.col("total_credit") - F.col("credit_nfc") - F.col("credit_households"))
    two = st.redundant_total(wide, "total_credit", ["credit_nfc", "credit_households"]).withColumn("parts", F.lit("two"))
    three = st.redundant_total(wide, "total_credit", ["credit_nfc", "credit_households", "rest"]).withColumn("parts", F.lit("three"))
    return two.unionByName(three)


def phillips_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phillips_band(spark, sf_dir).drop("band_low", "band_high")


def phillips_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.regression_band(economy(spark, sf_dir).monthly, "unemployment_rate", "hicp", 25)


def seasonal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.decompose(monthly_panel(economy(spark, sf_dir)), 12)
    return out.select("entity", "indicator", "period_start", *[rounded(c, 3).alias(c) for c in ("observed", "trend", "seasonal", "residual")])


def significance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, period, break and unit-root tests of every primary indicator, one row each."""
    panel = annual_panel(economy(spark, sf_dir))
    trend = st.trend_test(panel, period="year").select("entity", "indicator", "n", "slope", F.col("p_value").alias("trend_p"))
    periods = st.anova(st.period_stats(panel, PERIODS)).select("entity", "indicator", "f_statistic", F.col("p_value").alias("period_p"))
    breaks = st.break_test(panel, BREAKS).groupBy("entity", "indicator").agg(
        F.count("f_statistic").alias("n_breaks_tested"), F.count_if("significant").alias("n_breaks_significant"))
    keys = ["entity", "indicator"]
    roots = st.unit_root(panel, period="year").select(*keys, "adf_statistic", F.col("p_value").alias("adf_p"), "is_stationary")
    return trend.join(periods, keys, "left").join(breaks, keys, "left").join(roots, keys, "left")


def correlation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every correlation analysis stacked, the number of divergence years with them, and a note on suspiciously high values."""
    columns = ["section", "entity", "item", "n", "r", "p_value"]
    wh = economy(spark, sf_dir).shared(*MATRIX, "total_debt", "nominal_gdp")
    transmission = _transmission(wh, "total_credit").unionByName(_transmission(wh, "hicp"))
    pairs = _matrix(wh).withColumn("section", F.lit("matrix")).withColumn("item", F.concat_ws("~", "a", "b"))
    phillips = _phillips(wh).withColumn("section", F.lit("phillips")).withColumn("item", F.col("period"))
    rates = transmission.withColumn("section", F.lit("transmission")).withColumn("item", F.concat_ws("@", "effect", F.col("lag").cast("string")))
    debt = _debt_gdp(wh).withColumn("section", F.lit("debt_gdp")).withColumn("item", F.col("method"))
    split = _divergence(wh).groupBy("entity").agg(F.count("*").alias("n")).select(
        F.lit("divergence_years").alias("section"), "entity", F.lit("total_debt~nominal_gdp").alias("item"), "n", F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("p_value"))
    stacked = pairs.select(columns)
    for part in (phillips, rates, debt, split):
        stacked = stacked.unionByName(part.select(columns))
    return stacked.withColumn("note", F.when(F.abs("r") > 0.95, "suspiciously high").otherwise("ok"))


QUERIES = {f.__name__: f for f in (
    trend_tests, trend_tests_monthly, period_anova, period_pairwise, structural_breaks, lead_lag_tests, unit_roots, phillips_curve,
    rate_transmission, rate_transmission_best, debt_gdp_correlation, divergence_years, correlation_levels, correlation_differences,
    correlation_matrix, near_perfect_pairs, redundant_totals, phillips_fit, phillips_band, seasonal_parts, significance_report,
    correlation_report)}
