"""Panel, join and window operators on panels derived from orders and events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from indicatrix.functions.keys import period_key, period_start
from indicatrix.functions.numeric import as_cents, rounded
from indicatrix.operators import joins, windows
from indicatrix.operators.ranking import rank_large_groups, rank_peers
from indicatrix.plans.economy import PHILLIPS_PERIODS, economy, table, to_panel
from indicatrix.sources.dims import calendar_of, sources


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x day panel of the event stream: value in cents and counts."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("period_start")).agg(
        (F.sum(as_cents("value")) / 100.0).alias("value"), F.count("*").alias("n_events"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"))


def customer_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x quarter panel of order value: sparse, one row only where the customer ordered."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("entity"), period_start(F.col("o_orderdate"), "quarter").alias("period_start")).agg(
        (F.sum(as_cents("o_totalprice")) / 100.0).alias("spend"), F.count("*").alias("n_orders"))


def calendar_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both grains over the date range of the orders."""
    orders = table(spark, sf_dir, "orders")
    span = orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return calendar_of(orders, "o_orderdate").join(span, F.col("full_date").between(F.trunc("a", "month"), F.last_day("b"))).drop("a", "b")


def facts_with_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = economy(spark, sf_dir).monthly
    joined = joins.with_calendar(facts.select("entity", "date_key", "unemployment_rate"), calendar_of(facts))
    return joined.select("entity", "date_key", "full_date", "year", "quarter", "month", "month_name", "is_quarter_end", "unemployment_rate")


def orphan_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months from the first to the last fact of all nations, per nation, without a fact row."""
    monthly = economy(spark, sf_dir).monthly.select("entity", "date_key", "period_start")
    last = monthly.agg(F.max("period_start").alias("last"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"))
    months = calendar_of(monthly).where("month is not null").join(F.broadcast(last), F.col("full_date") <= F.col("last")).select("date_key")
    expected = nations.crossJoin(F.broadcast(months))  # 25 nations times the months of the facts' range
    return joins.missing_keys(expected, monthly, ["entity", "date_key"])


def overlapping_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that overlap: a year may count in two periods."""
    wh = economy(spark, sf_dir)
    monthly = wh.monthly.withColumn("year", F.year("period_start"))
    return joins.label_periods(monthly, PHILLIPS_PERIODS).groupBy("entity", "period").agg(
        F.count("*").alias("n"), rounded(F.avg("unemployment_rate"), 4).alias("mean"), F.min("year").alias("first_year"))


def lagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = economy(spark, sf_dir).monthly
    pairs = joins.lag_pairs(monthly, "ecb_main_refinancing_rate", "total_credit", [0, 3, 6, 12])
    return pairs.groupBy("entity", "lag").agg(F.count("*").alias("n"), rounded(F.sum("cause"), 4).alias("sum_cause"),
                                              rounded(F.sum("effect"), 2).alias("sum_effect"))


def lagged_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by shifted equi-join, for cause and effect from different tables."""
    monthly = economy(spark, sf_dir).shared("ecb_main_refinancing_rate", "total_credit").monthly
    pairs = joins.lag_join(monthly, "ecb_main_refinancing_rate", "total_credit", [0, 3, 6, 12])
    return pairs.groupBy("entity", "lag").agg(F.count("*").alias("n"), rounded(F.sum("cause"), 4).alias("sum_cause"),
                                              rounded(F.sum("effect"), 2).alias("sum_effect"))


def policy_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the last day's highest order price per segment, known only on days with orders, read at each month end."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # one row per customer and day before the join, so that a customer with very many orders is no hot key in it
    days = orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("change_date")).agg(
        F.max("o_totalprice").alias("price"))
    daily = days.join(customer, days.o_custkey == customer.c_custkey)
    changes = daily.groupBy(F.col("c_mktsegment").alias("entity"), "change_date").agg(F.max("price").alias("price"))
    last = orders.agg(F.max(F.col("o_orderdate").cast("date")).alias("last"))
    months = calendar_of(orders, "o_orderdate").where("month is not null").join(F.broadcast(last), F.col("full_date") <= F.col("last")).select(F.last_day("full_date").alias("period_end"))
    segments = customer.select(F.col("c_mktsegment").alias("entity")).distinct()
    return joins.as_of(changes, segments.join(F.broadcast(months)), "price")


def outer_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three series with different gaps on one key."""
    m = economy(spark, sf_dir).shared("hicp", "npl_ratio", "unemployment_rate").monthly
    parts = [m.where("hicp < 2").select("entity", "date_key", "hicp"), m.where("npl_ratio > 6").select("entity", "date_key", "npl_ratio"),
             m.where("unemployment_rate > 30").select("entity", "date_key", "unemployment_rate")]
    return joins.outer_merge(parts, ["entity", "date_key"])


def annual_to_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = economy(spark, sf_dir).shared("nominal_gdp").quarterly.select("entity", "period_start", "nominal_gdp")
    years = quarters.groupBy("entity", F.trunc("period_start", "year").alias("period_start")).agg(rounded(F.sum("nominal_gdp")).alias("annual"))
    return joins.broadcast_down(quarters, years, "annual")


def dense_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's quarters filled between its first and last order, with spend carried, interpolated and counted."""
    dense = joins.densify(customer_quarters(spark, sf_dir), grain="quarter")
    return dense.select("entity", "period_start", "is_filled", "spend", windows.fill("spend").alias("carried"),
                        rounded(windows.interpolate("spend"), 4).alias("interpolated"))


def dense_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User days on the full day range, zero where nothing happened, with a 7-day mean."""
    dense = joins.densify(user_days(spark, sf_dir), grain="day", start=F.lit(date(2024, 1, 1)), end=F.lit(date(2024, 1, 30)))
    zeroed = dense.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return zeroed.select("entity", "period_start", "is_filled", "value", rounded(windows.trailing("value", 7, min_obs=7), 4).alias("mean_7"))


def filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward, backward and two-sided fill over blanked months."""
    m = economy(spark, sf_dir).monthly.withColumn("x", F.when(F.month("period_start") % 4 == 2, F.col("unemployment_rate")))
    return m.select("entity", "period_start", windows.fill("x", "ffill").alias("forward"), windows.fill("x", "bfill").alias("backward"),
                    windows.fill("x", "both").alias("both"), rounded(windows.interpolate("x"), 6).alias("line"),
                    rounded(windows.leading_ramp("x", 0.0), 6).alias("ramp"))


def monthly_from_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter values placed on their first month and interpolated to months."""
    q = economy(spark, sf_dir).quarterly.select("entity", "period_start", F.col("gdp_per_capita").alias("value"))
    dense = joins.densify(q, grain="month")
    return dense.select("entity", "period_start", rounded(windows.interpolate("value"), 4).alias("value"))


def repeated_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series whose first three months repeat is blanked at the start and re-interpolated; others are left alone."""
    m = economy(spark, sf_dir).monthly.select("entity", "period_start", "total_credit")
    first = F.first("total_credit").over(windows.by_series())
    n = F.row_number().over(windows.by_series())
    made = m.withColumn("total_credit", F.when((F.col("entity") < "J") & (n <= 3), first).otherwise(F.col("total_credit")))
    blanked = windows.blank_repeated_start(made, ["total_credit"])
    return blanked.withColumn("filled", rounded(windows.interpolate("total_credit"), 4))


def calendar_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3- and 12-month means by calendar month, not by row."""
    m = economy(spark, sf_dir).monthly
    return m.select("entity", "date_key", *[rounded(windows.calendar_average(c, k), 4).alias(f"{c}_{k}m")
                                            for c in ("unemployment_rate", "hicp") for k in (3, 12)])


def year_on_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same month last year by date; a gap gives null instead of a neighbour."""
    m = economy(spark, sf_dir).monthly.select("entity", "period_start", "unemployment_rate", "total_credit")
    both = windows.same_period_last_year(windows.same_period_last_year(m, "unemployment_rate", "rate_ly"), "total_credit", "credit_ly")
    return both.select("entity", "period_start", rounded(F.col("unemployment_rate") - F.col("rate_ly")).alias("rate_change_pp"),
                       rounded((F.col("total_credit") - F.col("credit_ly")) / F.when(F.col("credit_ly") != 0, F.col("credit_ly")) * 100.0).alias("credit_change_pct"))


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = economy(spark, sf_dir).monthly
    return m.select("entity", "period_start", windows.observation_index().cast("int").alias("t"),
                    *[windows.change(c, 1).alias(f"{c}_diff") for c in ("unemployment_rate", "euribor_3m")],
                    rounded(windows.trailing("unemployment_rate", 12, min_obs=6), 4).alias("mean_min6"))


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = economy(spark, sf_dir).monthly.select("entity", "period_start", "unemployment_rate")
    out = m.transform(windows.smooth("unemployment_rate", 0.3))
    return out.withColumn("smoothed", rounded("smoothed", 4))


def latest_against_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value, and the one 12 observations back or else the first."""
    panel = to_panel(economy(spark, sf_dir).monthly, ["unemployment_rate", "hicp", "total_credit"]).where("value is not null")
    series = ["entity", "indicator"]
    newest = Window.partitionBy(*series).orderBy(F.desc("period_start"))
    ranked = panel.withColumn("k", F.row_number().over(newest))
    out = ranked.groupBy(*series).agg(
        F.max(F.when(F.col("k") == 1, F.col("value"))).alias("latest"),
        F.coalesce(F.max(F.when(F.col("k") == 13, F.col("value"))), F.min_by("value", "period_start")).alias("reference"))
    return out.withColumn("delta", rounded(F.col("latest") - F.col("reference"), 4))


def nation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each nation per year, best first; lower is better for the rate."""
    wide = economy(spark, sf_dir).monthly.groupBy("entity", F.year("period_start").alias("year")).agg(
        rounded(F.avg("unemployment_rate"), 4).alias("unemployment_rate"), rounded(F.sum("total_credit"), 2).alias("total_credit"))
    panel = wide.unpivot(["entity", "year"], ["unemployment_rate", "total_credit"], "indicator", "value")
    return rank_peers(panel, ["indicator", "year"], lower_is_better=F.col("indicator") == "unemployment_rate")


def customer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every customer within the year by spend: a peer group as large as the customer table."""
    orders = table(spark, sf_dir, "orders")
    spend = orders.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(
        (F.sum(as_cents("o_totalprice")) / 100.0).alias("value"))
    return rank_large_groups(spend, ["year"], buckets=64)


def indicator_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All unordered indicator pairs per entity and year (indicators are a fixed list)."""
    names = ["unemployment_rate", "hicp", "npl_ratio", "euribor_3m"]
    wide = economy(spark, sf_dir).monthly.groupBy("entity", F.year("period_start").alias("year")).agg(*[rounded(F.avg(c), 4).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) - F.col(b)).alias("difference"))
                      for i, a in enumerate(names) for b in names[i + 1:]])
    return wide.select("entity", "year", F.inline(pairs)).withColumn("difference", rounded("difference", 4))


def stacked_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide pillars of both grains stacked into the long form with a source name."""
    wh = economy(spark, sf_dir).shared("unemployment_rate", "hicp", "real_gdp")
    monthly = to_panel(wh.monthly, ["unemployment_rate", "hicp"], ("entity", "date_key")).withColumn("source_name", F.lit("Eurostat"))
    quarterly = to_panel(wh.quarterly, ["real_gdp"], ("entity", "date_key")).withColumn("source_name", F.lit("INE"))
    return monthly.unionByName(quarterly).join(sources(spark).select("source_key", "source_name"), "source_name")


def grain_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months to quarters by each indicator's own rule: sums, averages and last values."""
    m = economy(spark, sf_dir).monthly
    quarter = F.trunc("period_start", "quarter")
    return m.groupBy("entity", period_key(quarter, "quarter").alias("quarter_key")).agg(
        rounded(F.sum("total_credit")).alias("credit_sum"), rounded(F.avg("unemployment_rate"), 4).alias("rate_avg"),
        F.max_by("euribor_3m", F.when(F.col("euribor_3m").isNotNull(), F.col("period_start"))).alias("euribor_last"), F.count("*").alias("months"))


QUERIES = {f.__name__: f for f in (
    user_days, customer_quarters, calendar_dimension, facts_with_calendar, orphan_months, overlapping_periods, lagged_pairs,
    lagged_join, policy_steps, outer_merged, annual_to_quarters, dense_customers, dense_users, filled_gaps,
    monthly_from_quarters, repeated_start, calendar_averages, year_on_year, differences, smoothed, latest_against_back,
    nation_ranks, customer_ranks, indicator_pairs, stacked_indicators, grain_roll_up)}
