"""What-if scenarios: a baseline table (one row per entity) times a shock table, every impact a column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from indicatrix.functions.bands import band
from indicatrix.functions.numeric import ratio, rounded
from indicatrix.operators.joins import small_table
from indicatrix.registry import SCENARIO_PRIORS as PRIOR

POLICY, BOND = "ecb_main_refinancing_rate", "portugal_10y_bond_yield"
LATEST_MONTHLY = ["unemployment_rate", "hicp", POLICY, "euribor_12m", BOND, "total_credit", "npl_ratio"]
LATEST_QUARTERLY = ["nominal_gdp", "gdp_growth_yoy", "total_debt", "debt_to_gdp_ratio", "budget_deficit"]
DEBT_RISK = ([(">", 90, "HIGH")], "MODERATE")
LABOUR_RISK = ([("<", 7, "LOW")], "MODERATE")
PRICE_RISK = ([("<", 3, "LOW")], "ELEVATED")


def baseline(mixed: DataFrame) -> DataFrame:
    """Latest known value of each indicator, and output summed over the last four quarters."""
    back = F.row_number().over(Window.partitionBy("entity", "grain").orderBy(F.desc("period_start")))
    rows = mixed.withColumn("_k", back)

    def latest(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period_start"))).alias(c)

    recent = F.when((F.col("grain") == "quarter") & (F.col("_k") <= 4), F.col("nominal_gdp"))
    return rows.groupBy("entity").agg(*[latest(c) for c in LATEST_MONTHLY + LATEST_QUARTERLY], F.sum(recent).alias("annual_gdp"))


def calibrate(mixed: DataFrame) -> DataFrame:
    """Coefficients per entity by OLS, the textbook value where there are too few points.

    Okun: quarterly change of the mean unemployment rate on annual growth of the same quarter (10 points). Credit: monthly
    log growth in % on the change of the 12-month rate in points (20 points), so it is % per point.
    """
    quarters = mixed.groupBy("entity", F.trunc("period_start", "quarter").alias("period_start")).agg(
        F.avg("unemployment_rate").alias("u"), F.max("gdp_growth_yoy").alias("g"))
    order = Window.partitionBy("entity").orderBy("period_start")
    du = F.col("u") - F.lag("u").over(order)
    okun = quarters.withColumn("du", du).groupBy("entity").agg(F.regr_slope("du", "g").alias("okun_fit"), F.regr_count("du", "g").alias("okun_n"))
    months = mixed.where(F.col("grain") == "month").select(
        "entity", ((F.ln("total_credit") - F.ln(F.lag("total_credit").over(order))) * 100).alias("dc"),
        (F.col("euribor_12m") - F.lag("euribor_12m").over(order)).alias("dr"))
    credit = months.groupBy("entity").agg(F.regr_slope("dc", "dr").alias("credit_fit"), F.regr_count("dc", "dr").alias("credit_n"))
    both = okun.join(credit, "entity")
    use_okun, use_credit = (F.col("okun_n") >= 10) & F.col("okun_fit").isNotNull(), (F.col("credit_n") >= 20) & F.col("credit_fit").isNotNull()
    return both.select(
        "entity", F.when(use_okun, F.col("okun_fit")).otherwise(PRIOR["okun"]).alias("okun"),
        F.when(use_okun, "data-driven").otherwise("textbook").alias("okun_source"),
        F.when(use_credit, F.col("credit_fit")).otherwise(PRIOR["credit_rate_semi_elasticity"]).alias("credit_elasticity"),
        F.when(use_credit, "data-driven").otherwise("textbook").alias("credit_source"))


def _shocks(base: DataFrame, sizes: Sequence[float]) -> DataFrame:
    return base.crossJoin(small_table(base.sparkSession, [(float(s),) for s in sizes], "shock double"))


def rate_shock(base: DataFrame, coefficients: DataFrame, bps: Sequence[float] = (200.0,)) -> DataFrame:
    """Policy rate up by ``shock`` basis points."""
    rows = _shocks(base.join(coefficients, "entity"), bps)
    delta, shock = F.col("shock") / 100.0, F.col("shock")
    cost = F.col("total_debt") * delta / 100.0
    widening = shock * PRIOR["spread_pass_through"]
    return rows.select(
        "entity", "shock", rounded(POLICY, 3).alias("ecb_rate_base"), rounded(F.col(POLICY) + delta, 3).alias("ecb_rate_stressed"),
        rounded(F.col("euribor_12m") + delta, 3).alias("euribor_12m_stressed"), rounded(F.col(BOND) + delta + widening / 100.0, 3).alias("bond_yield_stressed"),
        rounded(cost, 1).alias("additional_debt_servicing"), rounded(ratio(cost, "annual_gdp") * 100).alias("debt_servicing_gdp_pct"),
        rounded(PRIOR["average_mortgage"] * (delta / 100.0) / 12.0, 0).alias("mortgage_monthly_increase"),
        rounded(F.col("credit_elasticity") * delta).alias("credit_growth_change_pct"), rounded(widening, 0).alias("spread_widening_bps"))


def output_shock(base: DataFrame, coefficients: DataFrame, pct: Sequence[float] = (-2.0,)) -> DataFrame:
    """Output changed by ``shock`` percent. A fall raises unemployment when the Okun coefficient is negative."""
    rows = _shocks(base.join(coefficients, "entity"), pct)
    shock = F.col("shock")
    move = F.col("okun") * shock
    new_ratio = ratio(F.col("total_debt"), F.col("annual_gdp") * (1 + shock / 100.0)) * 100
    tax = PRIOR["tax_revenue_gdp_elasticity"] * shock
    npl = PRIOR["npl_gdp_elasticity"] * shock
    return rows.select(
        "entity", "shock", rounded(F.col("gdp_growth_yoy") + shock).alias("gdp_growth_stressed"), rounded("unemployment_rate").alias("unemployment_base"),
        rounded(F.col("unemployment_rate") + move).alias("unemployment_stressed"), rounded(move).alias("unemployment_change_pp"),
        rounded(new_ratio).alias("debt_ratio_stressed"), rounded(new_ratio - F.col("debt_to_gdp_ratio")).alias("debt_ratio_change_pp"),
        rounded(F.greatest(F.col("npl_ratio") + npl, F.lit(0.0))).alias("npl_ratio_stressed"), rounded(tax).alias("tax_revenue_change_pct"),
        rounded(F.abs(F.col("annual_gdp") * PRIOR["tax_share_of_gdp"] * tax / 100.0), 1).alias("tax_revenue_loss"))


def inflation_shock(base: DataFrame, targets: Sequence[float] = (6.0,)) -> DataFrame:
    """Inflation moves to ``shock`` percent."""
    rows = _shocks(base, targets)
    shock = F.col("shock")
    delta = shock - F.col("hicp")
    boosted = F.col("annual_gdp") * (1 + delta / 100.0)
    new_ratio = ratio(F.col("total_debt"), boosted) * 100
    return rows.select(
        "entity", "shock", rounded(delta).alias("inflation_increase_pp"), rounded(F.col(BOND) - F.col("hicp")).alias("real_yield_base"),
        rounded(F.col(BOND) - shock).alias("real_yield_stressed"),
        rounded((ratio(1 + F.col("hicp") / 100.0, 1 + shock / 100.0) - 1) * 100).alias("purchasing_power_change_pct"),
        rounded(boosted, 1).alias("nominal_gdp_stressed"), rounded(new_ratio).alias("debt_ratio_stressed"),
        rounded(new_ratio - F.col("debt_to_gdp_ratio")).alias("debt_ratio_change_pp"),
        rounded(PRIOR["median_monthly_wage"] * delta / 100.0, 0).alias("household_cost_increase"))


def consolidation(base: DataFrame, targets: Sequence[float] = (-1.0,), max_years: int = 100) -> DataFrame:
    """Balance brought to ``shock`` % of output; years until the debt ratio is at its target, null when out of reach.

    Signs are explicit: a positive adjustment is tightening, and the balance enters the debt path as it is.
    """
    rows = _shocks(base, targets)
    effort = F.col("shock") - F.col("budget_deficit")
    drag = -PRIOR["fiscal_multiplier"] * effort
    rows = rows.withColumn("_a", (1 + F.col(BOND) / 100.0) / (1 + PRIOR["nominal_growth"]))
    def debt(year):
        power = F.pow(F.col("_a"), year)
        total = F.when(F.abs(F.col("_a") - 1) < 1e-12, year.cast("double")).otherwise((power - 1) / (F.col("_a") - 1))
        return F.col("debt_to_gdp_ratio") * power - F.col("shock") * total
    reached = F.filter(F.sequence(F.lit(1), F.lit(max_years)), lambda y: debt(y) <= PRIOR["debt_target"])
    years = F.when(F.col("debt_to_gdp_ratio") <= PRIOR["debt_target"], 0).when(F.size(reached) > 0, F.array_min(reached))
    return rows.select(
        "entity", "shock", rounded("budget_deficit").alias("balance_base"), rounded(F.abs(effort)).alias("adjustment_pp"),
        rounded(F.abs(effort) / 100.0 * F.col("annual_gdp"), 1).alias("adjustment_amount"), F.when(effort > 0, "tightening").otherwise("loosening").alias("direction"),
        rounded(drag).alias("gdp_impact_pct"), rounded(F.abs(drag) / 100.0 * F.col("annual_gdp"), 1).alias("gdp_impact_amount"), years.alias("years_to_target"))


def combined(base: DataFrame, coefficients: DataFrame, bps: float = 200.0, pct: float = -2.0) -> DataFrame:
    """Rate and output shock together, with risk bands of the starting point."""
    rows = base.join(coefficients, "entity")
    return rows.select(
        "entity", rounded(F.col("unemployment_rate") + F.col("okun") * pct).alias("worst_unemployment_pct"),
        rounded(ratio(F.col("total_debt"), F.col("annual_gdp") * (1 + pct / 100.0)) * 100).alias("worst_debt_to_gdp_pct"),
        rounded(F.col("total_debt") * (bps / 100.0) / 100.0, 1).alias("worst_additional_debt_cost"), band("debt_to_gdp_ratio", DEBT_RISK).alias("debt_risk"),
        band("unemployment_rate", LABOUR_RISK).alias("labour_risk"), band("hicp", PRICE_RISK).alias("price_risk"))


def report(base: DataFrame, coefficients: DataFrame, bps: float = 200.0, pct: float = -2.0, inflation: float = 6.0, balance: float = -1.0) -> DataFrame:
    """The combined worst case and, beside it, each of the four scenarios it rests on, one row for each entity; columns carry the scenario's name."""
    parts = {"rate": rate_shock(base, coefficients, (bps,)), "output": output_shock(base, coefficients, (pct,)), "inflation": inflation_shock(base, (inflation,)),
             "consolidation": consolidation(base, (balance,))}
    out = combined(base, coefficients, bps, pct)
    for name, part in parts.items():
        out = out.join(part.select("entity", *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c not in ("entity", "shock")]), "entity", "left")
    return out
