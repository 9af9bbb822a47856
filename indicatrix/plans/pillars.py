"""The 36 named pillar queries: each maps a Warehouse to a DataFrame with one extra key column, ``entity``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from indicatrix.functions.bands import band
from indicatrix.functions.numeric import minmax_score, pct_change, rounded, share
from indicatrix.operators.joins import label_periods, period_label
from indicatrix.operators.windows import by_series, change, cumulative_index, episodes, lagged, trailing, whole_series
from indicatrix.plans.economy import Warehouse

YEAR = ("entity",)


def _year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("period_start"))


def _r(value: Column | str, digits: int = 2) -> Column:
    return rounded(value, digits)


def _month_columns() -> list[Column]:
    return [F.col("entity"), F.year("period_start").alias("year"), F.month("period_start").alias("month"),
            F.col("date_key")]


def _quarter_columns() -> list[Column]:
    return [F.col("entity"), F.year("period_start").alias("year"), F.quarter("period_start").alias("quarter"),
            F.col("date_key")]


def _last_year(value: str) -> Column:
    """Value one year earlier in a yearly table; null where that year is missing."""
    w = Window.partitionBy("entity").orderBy("year").rangeBetween(-1, -1)
    return F.max(value).over(w)


# ---- output -------------------------------------------------------------------------------------------------------

def _annual_gdp(wh: Warehouse) -> DataFrame:
    return _year(wh.fact("gdp")).groupBy("entity", "year").agg(
        F.sum("nominal_gdp").alias("nominal"), F.sum("real_gdp").alias("real"),
        F.avg("gdp_per_capita").alias("per_capita"), F.count("*").alias("quarters_reported"),
    )


def gdp_annual_summary(wh: Warehouse) -> DataFrame:
    annual = _annual_gdp(wh)
    return annual.select(
        "entity", "year", "quarters_reported",
        _r("nominal").alias("annual_nominal_gdp_eur_m"), _r("real").alias("annual_real_gdp_eur_m"),
        _r("per_capita").alias("avg_gdp_per_capita_eur"),
        _r(pct_change(F.col("real"), _last_year("real"))).alias("real_gdp_yoy_growth_pct"),
    )


def gdp_growth_ranking(wh: Warehouse) -> DataFrame:
    grown = _annual_gdp(wh).withColumn("before", _last_year("real")).where("before is not null")
    grown = grown.withColumn("real_gdp_growth_pct", _r(pct_change(F.col("real"), F.col("before"))))
    best_first = Window.partitionBy("entity").orderBy(F.desc("real_gdp_growth_pct"))
    return grown.select(
        "entity", F.rank().over(best_first).alias("growth_rank"), "year", "real_gdp_growth_pct",
        band("real_gdp_growth_pct", "growth_class").alias("classification"),
    )


def gdp_period_comparison(wh: Warehouse) -> DataFrame:
    labelled = label_periods(_year(wh.fact("gdp")), wh.periods)
    return labelled.groupBy("entity", F.col("period").alias("economic_period")).agg(
        F.count("*").alias("quarter_count"),
        _r(F.avg("nominal_gdp")).alias("avg_nominal_gdp_eur_m"),
        _r(F.avg("real_gdp")).alias("avg_real_gdp_eur_m"),
        _r(F.avg("gdp_growth_yoy")).alias("avg_yoy_growth_pct"),
        _r(F.avg("gdp_per_capita")).alias("avg_gdp_per_capita_eur"),
        _r(F.min("gdp_growth_yoy")).alias("worst_quarter_growth_pct"),
        _r(F.max("gdp_growth_yoy")).alias("best_quarter_growth_pct"),
    )


def gdp_quarter_seasonality(wh: Warehouse) -> DataFrame:
    out = wh.fact("gdp").groupBy("entity", F.quarter("period_start").alias("quarter")).agg(
        F.count("*").alias("observations"),
        _r(F.avg("nominal_gdp")).alias("avg_nominal_gdp_eur_m"),
        _r(F.avg("real_gdp")).alias("avg_real_gdp_eur_m"),
        _r(F.avg("gdp_growth_qoq")).alias("avg_qoq_growth_pct"),
        _r(F.avg("gdp_growth_yoy")).alias("avg_yoy_growth_pct"),
        _r(F.min("gdp_growth_qoq")).alias("min_qoq_growth_pct"),
        _r(F.max("gdp_growth_qoq")).alias("max_qoq_growth_pct"),
    )
    return out.withColumn("quarter_label", F.concat(F.lit("Q"), F.col("quarter").cast("string")))


def gdp_per_capita_evolution(wh: Warehouse) -> DataFrame:
    level = F.col("per_capita")
    base = F.first("per_capita").over(
        by_series(period="year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return _annual_gdp(wh).select(
        "entity", "year", _r(level).alias("gdp_per_capita_eur"),
        _r(pct_change(level, _last_year("per_capita"))).alias("yoy_change_pct"),
        _r(pct_change(level, base)).alias("cumulative_growth_from_base_pct"),
    )


# ---- unemployment -------------------------------------------------------------------------------------------------

def unemp_trend_ma12(wh: Warehouse) -> DataFrame:
    average = trailing("unemployment_rate", 12)
    return wh.fact("unemployment").select(
        *_month_columns(), "unemployment_rate", _r(average).alias("unemployment_rate_12m_ma"),
        _r(F.col("unemployment_rate") - average).alias("deviation_from_ma"),
    )


def unemp_youth_gap(wh: Warehouse) -> DataFrame:
    rate, youth = F.col("unemployment_rate"), F.col("youth_unemployment_rate")
    multiple = F.when(rate > 0, youth / F.when(rate != 0, rate))
    return wh.fact("unemployment").dropna(subset=["unemployment_rate", "youth_unemployment_rate"]).select(
        *_month_columns(), rate, youth, _r(youth - rate).alias("absolute_gap_pp"),
        _r(multiple).alias("youth_to_general_ratio"), _r(trailing(multiple, 12)).alias("ratio_12m_ma"),
    )


def unemp_annual_stats(wh: Warehouse) -> DataFrame:
    rate = "unemployment_rate"
    return _year(wh.fact("unemployment")).groupBy("entity", "year").agg(
        F.count("*").alias("months_reported"),
        _r(F.avg(rate)).alias("avg_unemployment_pct"), _r(F.min(rate)).alias("min_unemployment_pct"),
        _r(F.max(rate)).alias("max_unemployment_pct"),
        _r(F.max(rate) - F.min(rate)).alias("intra_year_range_pp"),
        _r(F.stddev_pop(rate)).alias("stddev_unemployment"),
        _r(F.avg("youth_unemployment_rate")).alias("avg_youth_unemployment_pct"),
        _r(F.avg("long_term_unemployment_rate")).alias("avg_long_term_unemployment_pct"),
    )


def unemp_period_impact(wh: Warehouse) -> DataFrame:
    labelled = label_periods(_year(wh.fact("unemployment")), wh.periods)
    return labelled.groupBy("entity", F.col("period").alias("economic_period")).agg(
        F.count("*").alias("month_count"),
        _r(F.avg("unemployment_rate")).alias("avg_unemployment_pct"),
        _r(F.max("unemployment_rate")).alias("peak_unemployment_pct"),
        _r(F.avg("youth_unemployment_rate")).alias("avg_youth_unemployment_pct"),
        _r(F.avg("long_term_unemployment_rate")).alias("avg_long_term_unemployment_pct"),
        _r(F.avg("labour_force_participation_rate")).alias("avg_participation_rate_pct"),
    )


def labour_health_index(wh: Warehouse) -> DataFrame:
    columns = ("unemployment_rate", "labour_force_participation_rate")
    whole = whole_series()

    def score(c: str, invert: bool) -> Column:
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        return _r(minmax_score(F.col(c), low, high, invert, flat=None))

    scored = wh.fact("unemployment").dropna(subset=list(columns)).select(
        *_month_columns(), *columns,
        score(columns[0], True).alias("unemployment_score"), score(columns[1], False).alias("participation_score"),
    )
    index = 0.60 * F.col("unemployment_score") + 0.40 * F.col("participation_score")
    return scored.withColumn("labour_market_health_index", _r(index))


# ---- credit -------------------------------------------------------------------------------------------------------

def credit_evolution(wh: Warehouse) -> DataFrame:
    return wh.fact("credit").select(
        *_month_columns(), _r("total_credit").alias("total_credit_eur_m"), _r("credit_nfc").alias("credit_nfc_eur_m"),
        _r("credit_households").alias("credit_households_eur_m"),
        _r(change("total_credit", 12, "pct")).alias("total_credit_yoy_growth_pct"),
    )


def credit_composition(wh: Warehouse) -> DataFrame:
    total = F.col("total_credit")
    rest = total - F.col("credit_nfc") - F.col("credit_households")
    return wh.fact("credit").select(
        *_month_columns(), _r(total).alias("total_credit_eur_m"), _r("credit_nfc").alias("credit_nfc_eur_m"),
        _r("credit_households").alias("credit_households_eur_m"),
        _r(share("credit_nfc", total)).alias("nfc_share_pct"),
        _r(share("credit_households", total)).alias("household_share_pct"),
        _r(share(rest, total)).alias("other_share_pct"),
    )


def npl_trend(wh: Warehouse) -> DataFrame:
    return wh.fact("credit").where("npl_ratio is not null").select(
        *_month_columns(), _r("npl_ratio").alias("npl_ratio_pct"), _r(trailing("npl_ratio", 12)).alias("npl_ratio_12m_ma"),
        band("npl_ratio", "npl_class").alias("npl_classification"), lagged("npl_ratio", 12).alias("npl_ratio_12m_ago"),
        _r(change("npl_ratio", 12)).alias("npl_change_yoy_pp"),
    )


def credit_to_gdp(wh: Warehouse) -> DataFrame:
    """Quarter-end month credit over the same quarter's output: both grains meet on the start of the quarter."""
    is_quarter_end = (F.col("grain") == "month") & (F.month("period_start") % 3 == 0)
    by_quarter = wh.mixed.groupBy("entity", F.trunc("period_start", "quarter").alias("period_start")).agg(
        F.max(F.when(is_quarter_end, F.col("total_credit"))).alias("credit"),
        F.max("nominal_gdp").alias("output"),
        F.count_if(is_quarter_end).alias("months"), F.count_if(F.col("grain") == "quarter").alias("quarters"),
    )
    quarter = F.quarter("period_start")
    return by_quarter.where("months > 0 and quarters > 0").select(
        "entity", F.year("period_start").alias("year"), quarter.alias("quarter"),
        F.concat(F.lit("Q"), quarter.cast("string")).alias("quarter_label"),
        _r("credit").alias("total_credit_eur_m"), _r("output").alias("nominal_gdp_eur_m"),
        _r(share("credit", "output")).alias("credit_to_gdp_ratio_pct"),
    )


def deleveraging_episodes(wh: Warehouse) -> DataFrame:
    moves = wh.fact("credit").withColumn("before", lagged("total_credit")).where("before is not null")
    moves = moves.withColumn("move", F.col("total_credit") - F.col("before"))
    runs = episodes(moves, F.col("move") < 0, 3, aggregates=[
        F.min("date_key").alias("episode_start"), F.max("date_key").alias("episode_end"),
        F.sum("move").alias("total"), F.max("total_credit").alias("peak"),
    ])
    return runs.select(
        "entity", "episode_start", "episode_end", F.col("episode_length").alias("consecutive_months"),
        _r("total").alias("total_credit_change_eur_m"), _r(share("total", "peak")).alias("pct_change_over_episode"),
    )


# ---- interest rates -----------------------------------------------------------------------------------------------

POLICY, BOND = "ecb_main_refinancing_rate", "portugal_10y_bond_yield"


def rate_environment(wh: Warehouse) -> DataFrame:
    return wh.fact("interest_rates").where(f"{POLICY} is not null").select(
        *_month_columns(), POLICY, band(POLICY, "rate_environment").alias("rate_environment"),
        _r(trailing(POLICY, 12), 3).alias("ecb_rate_12m_ma"),
    )


def yield_spread(wh: Warehouse) -> DataFrame:
    spread = F.col(BOND) - F.col(POLICY)
    return wh.fact("interest_rates").dropna(subset=[POLICY, BOND]).select(
        *_month_columns(), BOND, POLICY, _r(spread, 3).alias("sovereign_spread_pp"),
        band(spread, "spread_stress").alias("stress_level"), _r(trailing(spread, 12), 3).alias("spread_12m_ma"),
    )


def euribor_term_structure(wh: Warehouse) -> DataFrame:
    e3, e6, e12 = (F.col(f"euribor_{k}m") for k in (3, 6, 12))
    shape = F.when((e12 > e6) & (e6 > e3), "Normal (upward)").when((e12 < e6) & (e6 < e3), "Inverted")
    return wh.fact("interest_rates").dropna(subset=["euribor_3m", "euribor_6m", "euribor_12m"]).select(
        *_month_columns(), e3, e6, e12, _r(e6 - e3, 3).alias("spread_6m_3m_pp"), _r(e12 - e3, 3).alias("spread_12m_3m_pp"),
        _r(e12 - e6, 3).alias("spread_12m_6m_pp"), shape.otherwise("Flat / Mixed").alias("curve_shape"),
    )


def rate_momentum(wh: Warehouse) -> DataFrame:
    moves = wh.fact("interest_rates").where(f"{POLICY} is not null").select(
        "entity", "period_start", "date_key", POLICY, change(POLICY, 1).alias("mom"), change(POLICY, 12).alias("yoy"))
    return moves.where("mom is not null").select(
        *_month_columns(), POLICY, _r("mom", 3).alias("mom_change_pp"), _r("yoy", 3).alias("yoy_change_pp"),
        band("mom", "policy_direction").alias("policy_direction"),
        _r(trailing("mom", 6, F.sum), 3).alias("cumulative_6m_change_pp"),
    )


def crisis_premium(wh: Warehouse) -> DataFrame:
    rates = _year(wh.fact("interest_rates")).where(f"{BOND} is not null")
    spread = F.col(BOND) - F.col(POLICY)
    return label_periods(rates, wh.periods).groupBy("entity", F.col("period").alias("economic_period")).agg(
        F.count("*").alias("month_count"), _r(F.avg(BOND), 3).alias("avg_bond_yield_pct"),
        _r(F.max(BOND), 3).alias("peak_bond_yield_pct"), _r(F.min(BOND), 3).alias("min_bond_yield_pct"),
        _r(F.avg(POLICY), 3).alias("avg_ecb_rate_pct"), _r(F.avg(spread), 3).alias("avg_spread_pp"),
        _r(F.max(spread), 3).alias("max_spread_pp"),
    )


# ---- inflation ----------------------------------------------------------------------------------------------------

def inflation_regime(wh: Warehouse) -> DataFrame:
    return wh.fact("inflation").where("hicp is not null").select(
        *_month_columns(), "hicp", band("hicp", "inflation_regime").alias("inflation_regime"),
        _r(trailing("hicp", 12)).alias("hicp_12m_ma"),
    )


def core_headline_spread(wh: Warehouse) -> DataFrame:
    spread = F.col("hicp") - F.col("core_inflation")
    return wh.fact("inflation").dropna(subset=["hicp", "core_inflation"]).select(
        *_month_columns(), F.col("hicp").alias("headline_hicp_pct"), F.col("core_inflation").alias("core_inflation_pct"),
        _r(spread).alias("headline_core_spread_pp"), band(spread, "energy_food_impact").alias("energy_food_impact"),
        _r(trailing(spread, 12)).alias("spread_12m_ma"),
    )


def inflation_price_index(wh: Warehouse) -> DataFrame:
    annual = _year(wh.fact("inflation")).groupBy("entity", "year").agg(
        F.count("*").alias("months_reported"), F.avg("hicp").alias("headline"), F.avg("cpi_estimated").alias("cpi"),
        F.avg("core_inflation").alias("core"),
    )
    return annual.where("headline is not null").select(
        "entity", "year", "months_reported", _r("headline").alias("avg_hicp_pct"), _r("cpi").alias("avg_cpi_estimated_pct"),
        _r("core").alias("avg_core_inflation_pct"),
        _r(cumulative_index("headline", period="year")).alias("cumulative_price_index"),
    )


def real_interest_rate(wh: Warehouse) -> DataFrame:
    real = F.col(POLICY) - F.col("hicp")
    return wh.monthly.dropna(subset=["hicp", POLICY]).select(
        *_month_columns(), F.col(POLICY).alias("ecb_rate_pct"), F.col("hicp").alias("inflation_pct"),
        _r(real).alias("real_interest_rate_pct"), band(real, "monetary_stance").alias("monetary_stance"),
        _r(trailing(real, 12)).alias("real_rate_12m_ma"),
    )


def inflation_acceleration(wh: Warehouse) -> DataFrame:
    moves = wh.fact("inflation").where("hicp is not null").select(
        "entity", "period_start", "date_key", "hicp", change("hicp", 1).alias("mom"), change("hicp", 12).alias("yoy"))
    # the quarter change counts rows after the first month is dropped, as its filter comes first
    return moves.where("mom is not null").select(
        *_month_columns(), F.col("hicp").alias("hicp_pct"), _r("mom").alias("mom_acceleration_pp"),
        _r("yoy").alias("yoy_acceleration_pp"), band("mom", "momentum").alias("momentum_classification"),
        _r(change("hicp", 3)).alias("acceleration_3m_pp"),
    )


# ---- public debt --------------------------------------------------------------------------------------------------

def debt_sustainability(wh: Warehouse) -> DataFrame:
    yearly = change("debt_to_gdp_ratio", 4)
    return wh.fact("public_debt").select(
        *_quarter_columns(), _r("total_debt").alias("total_debt_eur_m"), _r("debt_to_gdp_ratio").alias("debt_to_gdp_pct"),
        band("debt_to_gdp_ratio", "debt_light").alias("sustainability_traffic_light"),
        _r(change("debt_to_gdp_ratio", 1)).alias("qoq_change_pp"), _r(yearly).alias("yoy_change_pp"),
        band(yearly, "trend_direction").alias("trend_direction"),
    )


def fiscal_balance_trend(wh: Warehouse) -> DataFrame:
    annual = _year(wh.fact("public_debt")).groupBy("entity", "year").agg(
        F.count("*").alias("quarters_reported"), F.avg("budget_deficit").alias("balance"),
        F.min("budget_deficit").alias("worst"), F.max("budget_deficit").alias("best"),
    )
    return annual.select(
        "entity", "year", "quarters_reported", _r("balance").alias("avg_budget_balance_pct_gdp"),
        _r("worst").alias("worst_quarter_pct_gdp"), _r("best").alias("best_quarter_pct_gdp"),
        band("balance", "fiscal_status").alias("fiscal_status"),
        _r(change("balance", 1, period="year")).alias("yoy_change_pp"),
    )


def debt_composition(wh: Warehouse) -> DataFrame:
    outside, total = F.col("external_debt_share_estimated"), F.col("total_debt")
    return wh.fact("public_debt").where("external_debt_share_estimated is not null").select(
        *_quarter_columns(), _r(total).alias("total_debt_eur_m"), _r(outside).alias("external_debt_share_pct"),
        _r(100.0 - outside).alias("domestic_debt_share_pct"),
        _r(total * outside / 100.0).alias("external_debt_eur_m"),
        _r(total * (100.0 - outside) / 100.0).alias("domestic_debt_eur_m"),
        _r(change(outside, 4)).alias("external_share_yoy_change_pp"),
    )


def debt_vs_gdp(wh: Warehouse) -> DataFrame:
    debt_growth, output_growth = F.col("debt_yoy_growth_pct"), F.col("gdp_growth_yoy")
    known = debt_growth.isNotNull() & output_growth.isNotNull()
    dynamics = F.when(known & (debt_growth > output_growth), "Debt outpacing GDP").when(known, "GDP outpacing debt")
    grown = wh.quarterly.withColumn("debt_yoy_growth_pct", _r(change("total_debt", 4, "pct")))
    return grown.select(
        *_quarter_columns(), _r("total_debt").alias("total_debt_eur_m"), debt_growth,
        _r("nominal_gdp").alias("nominal_gdp_eur_m"), output_growth.alias("gdp_yoy_growth_pct"),
        _r(F.coalesce(debt_growth, F.lit(0.0)) - F.coalesce(output_growth, F.lit(0.0))).alias("debt_gdp_growth_gap_pp"),
        dynamics.otherwise("Insufficient data").alias("dynamics"),
    )


def consolidation_episodes(wh: Warehouse) -> DataFrame:
    balance = wh.fact("public_debt").where("budget_deficit is not null")
    moves = balance.withColumn("move", change("budget_deficit", 1)).where("move is not null")
    runs = episodes(moves, F.col("move") > 0, 2, aggregates=[
        F.min("date_key").alias("episode_start"), F.max("date_key").alias("episode_end"), F.sum("move").alias("total"),
        F.min("budget_deficit").alias("worst"), F.max("budget_deficit").alias("best"),
    ])
    return runs.select(
        "entity", "episode_start", "episode_end", F.col("episode_length").alias("consecutive_quarters"),
        _r("total").alias("total_improvement_pp"), _r("worst").alias("worst_balance_in_episode_pct"),
        _r("best").alias("best_balance_in_episode_pct"),
    )


# ---- across pillars -----------------------------------------------------------------------------------------------

def macro_dashboard_latest(wh: Warehouse) -> DataFrame:
    """Latest row of each grain per entity, side by side, in one aggregation."""
    monthly = ["unemployment_rate", "youth_unemployment_rate", "total_credit", "npl_ratio", POLICY, BOND, "hicp",
               "core_inflation"]
    quarterly = ["nominal_gdp", "gdp_growth_yoy", "gdp_per_capita", "total_debt", "debt_to_gdp_ratio", "budget_deficit"]
    def latest(grain: str, columns: list[str]) -> Column:
        at = F.when(F.col("grain") == grain, F.col("period_start"))
        return F.max_by(F.struct("date_key", *columns), at).alias(grain)
    both = wh.mixed.groupBy("entity").agg(latest("month", monthly), latest("quarter", quarterly))
    m, q = (lambda c: F.col(f"month.{c}")), (lambda c: F.col(f"quarter.{c}"))
    return both.select(
        "entity", q("date_key").alias("gdp_date"), _r(q("nominal_gdp")).alias("nominal_gdp_eur_m"),
        _r(q("gdp_growth_yoy")).alias("gdp_growth_yoy_pct"), _r(q("gdp_per_capita")).alias("gdp_per_capita_eur"),
        m("date_key").alias("unemployment_date"), m("unemployment_rate").alias("unemployment_rate_pct"),
        m("youth_unemployment_rate").alias("youth_unemployment_pct"), m("date_key").alias("credit_date"),
        _r(m("total_credit")).alias("total_credit_eur_m"), m("npl_ratio").alias("npl_ratio_pct"),
        m("date_key").alias("rates_date"), m(POLICY).alias("ecb_rate_pct"), m(BOND).alias("bond_yield_10y_pct"),
        m("date_key").alias("inflation_date"), m("hicp").alias("hicp_pct"),
        m("core_inflation").alias("core_inflation_pct"), q("date_key").alias("debt_date"),
        _r(q("total_debt")).alias("total_debt_eur_m"), q("debt_to_gdp_ratio").alias("debt_to_gdp_pct"),
        q("budget_deficit").alias("budget_balance_pct_gdp"),
    )


# score column, yearly measure, better when low
SCORECARD = [
    ("gdp_score", "avg_gdp_growth", False),
    ("unemployment_score", "avg_unemployment", True),
    ("inflation_score", "inflation_deviation", True),
    ("credit_health_score", "avg_npl_ratio", True),
    ("fiscal_score", "avg_debt_to_gdp", True),
    ("financial_stability_score", "avg_spread", True),
]


def health_scorecard(wh: Warehouse) -> DataFrame:
    annual = _year(wh.mixed).groupBy("entity", "year").agg(
        F.avg("gdp_growth_yoy").alias("avg_gdp_growth"), F.avg("unemployment_rate").alias("avg_unemployment"),
        F.abs(F.avg("hicp") - 2.0).alias("inflation_deviation"), F.avg("npl_ratio").alias("avg_npl_ratio"),
        F.avg("debt_to_gdp_ratio").alias("avg_debt_to_gdp"), F.avg(F.col(BOND) - F.col(POLICY)).alias("avg_spread"),
    ).where("avg_gdp_growth is not null")
    whole = whole_series()
    for name, measure, invert in SCORECARD:
        low, high = F.min(measure).over(whole), F.max(measure).over(whole)
        annual = annual.withColumn(name, minmax_score(F.col(measure), low, high, invert, flat=None))
    names = [name for name, _, _ in SCORECARD]
    total = sum((F.col(n) / 100.0 for n in names[1:]), F.col(names[0]) / 100.0)
    return annual.select(
        "entity", "year", *[_r(n, 1).alias(n) for n in names], _r(total / 6.0 * 100.0, 1).alias("composite_health_index"),
    )


def crisis_timeline(wh: Warehouse) -> DataFrame:
    def flag(test: Column) -> Column:
        return F.when(test, 1).otherwise(0)

    flags = (flag(F.col("unemployment_rate") > 12.0) + flag((F.col("hicp") < 0) | (F.col("hicp") > 4.0))
             + flag(F.col("npl_ratio") > 7.0) + flag(F.col(BOND) > 6.0))
    return wh.monthly.withColumn("stress_count", flags).where("stress_count >= 1").select(
        *_month_columns(), "stress_count", band("stress_count", "stress_class").alias("stress_classification"),
        "unemployment_rate", F.col("hicp").alias("inflation_pct"), F.col("npl_ratio").alias("npl_ratio_pct"),
        F.col(BOND).alias("bond_yield_pct"),
    )


def phillips_annual(wh: Warehouse) -> DataFrame:
    both = _year(wh.monthly).dropna(subset=["unemployment_rate", "hicp"]).groupBy("entity", "year").agg(
        _r(F.avg("unemployment_rate")).alias("avg_unemployment_pct"), _r(F.avg("hicp")).alias("avg_inflation_pct"),
        _r(F.avg("core_inflation")).alias("avg_core_inflation_pct"),
    )
    return both.withColumn("economic_period", period_label(F.col("year"), wh.periods))


def rate_transmission_lags(wh: Warehouse) -> DataFrame:
    grown = wh.monthly.select("entity", "period_start", "date_key", POLICY,
                              change("total_credit", 12, "pct").alias("growth"))
    kept = grown.where("growth is not null")
    return kept.select(
        *_month_columns(), _r(POLICY, 3).alias("ecb_rate_pct"), _r("growth").alias("credit_yoy_growth_pct"),
        *[_r(lagged(POLICY, k), 3).alias(f"ecb_rate_{k}m_lag") for k in (3, 6, 12)],
        _r(change(POLICY, 12), 3).alias("ecb_rate_change_12m_pp"),
    )


def annual_snapshot(wh: Warehouse) -> DataFrame:
    """All pillars per year: conditional aggregates over the mixed-grain table instead of six joins."""
    annual = _year(wh.mixed).groupBy("entity", "year").agg(
        F.sum("nominal_gdp").alias("nominal"), *[F.avg(c).alias(c) for c in (
            "gdp_growth_yoy", "gdp_per_capita", "unemployment_rate", "youth_unemployment_rate",
            "labour_force_participation_rate", "total_credit", "npl_ratio", POLICY, "euribor_12m", BOND, "hicp",
            "core_inflation", "total_debt", "debt_to_gdp_ratio", "budget_deficit")],
        F.count_if(F.col("grain") == "quarter").alias("quarters"),
    ).where("quarters > 0")
    label = period_label(F.col("year"), [(name.split(". ", 1)[-1], a, b) for name, a, b in wh.periods])
    return annual.select(
        "entity", "year", label.alias("economic_period"), _r("nominal", 0).alias("nominal_gdp_eur_m"),
        _r("gdp_growth_yoy").alias("gdp_growth_yoy_pct"), _r("gdp_per_capita", 0).alias("gdp_per_capita_eur"),
        _r("unemployment_rate").alias("unemployment_pct"), _r("youth_unemployment_rate").alias("youth_unemployment_pct"),
        _r("labour_force_participation_rate").alias("participation_rate_pct"),
        _r("total_credit", 0).alias("total_credit_eur_m"), _r("npl_ratio").alias("npl_ratio_pct"),
        _r(POLICY, 3).alias("ecb_rate_pct"), _r("euribor_12m", 3).alias("euribor_12m_pct"),
        _r(BOND, 3).alias("bond_yield_10y_pct"), _r(F.col(BOND) - F.col(POLICY), 3).alias("sovereign_spread_pp"),
        _r("hicp").alias("hicp_pct"), _r("core_inflation").alias("core_inflation_pct"),
        _r(F.col(POLICY) - F.col("hicp")).alias("real_interest_rate_pct"), _r("total_debt", 0).alias("total_debt_eur_m"),
        _r("debt_to_gdp_ratio").alias("debt_to_gdp_pct"), _r("budget_deficit").alias("budget_balance_pct_gdp"),
    )


NAMED: dict[str, Callable[[Warehouse], DataFrame]] = {
    f.__name__: f for f in (
        gdp_annual_summary, gdp_growth_ranking, gdp_period_comparison, gdp_quarter_seasonality,
        gdp_per_capita_evolution, unemp_trend_ma12, unemp_youth_gap, unemp_annual_stats, unemp_period_impact,
        labour_health_index, credit_evolution, credit_composition, npl_trend, credit_to_gdp, deleveraging_episodes,
        rate_environment, yield_spread, euribor_term_structure, rate_momentum, crisis_premium, inflation_regime,
        core_headline_spread, inflation_price_index, real_interest_rate, inflation_acceleration, debt_sustainability,
        fiscal_balance_trend, debt_composition, debt_vs_gdp, consolidation_episodes, macro_dashboard_latest,
        health_scorecard, crisis_timeline, phillips_annual, rate_transmission_lags, annual_snapshot,
    )
}
