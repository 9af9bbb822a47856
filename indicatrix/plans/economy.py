"""Six macro-style pillars derived from the order tables, one economy per entity.

The only heavy step is ``monthly_cube``: lineitem is reduced to one row per order (map-side combine, one shuffle on the
order key, which the join to orders reuses), orders to one row per customer and month before they meet customers (so
that a customer holding a large part of all orders is already collapsed), and the result to one row per entity and
month. Everything downstream works on that cube, whose size is entities x months and does not grow with the orders.

All measures are whole cents, points or counts, so sums are exact whatever order the cluster adds them in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from indicatrix.functions.keys import period_key, period_start
from indicatrix.operators.joins import outer_merge
from indicatrix.registry import CRISIS_WINDOWS as registry_windows, ECONOMIC_PERIODS, PILLARS
from indicatrix.registry import PHILLIPS_PERIODS as registry_phillips
from indicatrix.session import ensure_checkpoint_dir

# Labelled year ranges for the order tables (1995 to 2001); same labels as the registry's default set.
PERIODS = [
    ("1. Pre-crisis", 1995, 1995),
    ("2. Troika", 1996, 1997),
    ("3. Recovery", 1998, 1999),
    ("4. COVID", 2000, 2000),
    ("5. Post-COVID", 2001, 2001),
]
CRISIS_WINDOWS = [("Sovereign Debt Crisis", 1996, 1997), ("COVID-19 Pandemic", 1999, 2000),
                  ("Energy and Inflation Crisis", 2000, 2001)]
PHILLIPS_PERIODS = [("pre_crisis", 1995, 1996), ("troika", 1996, 1997), ("recovery", 1998, 1999),
                    ("covid", 2000, 2000), ("post_covid", 2001, 2001)]

Build = Callable[[], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _aggregates(expressions: dict[str, str]) -> list[Column]:
    """Aggregates written as SQL text: one call to the JVM each instead of one per operator in them."""
    return [F.expr(f"{text} AS {name}") for name, text in expressions.items()]


# rint keeps the conversion to whole cents and points inside generated code
GROSS, DISCOUNT, TAX, PRICE = (f"CAST(rint({c} * 100) AS BIGINT)" for c in ("l_extendedprice", "l_discount", "l_tax", "o_totalprice"))
LINE_MEASURES = {
    "n_lines": "count(*)",
    "gross_c": f"sum({GROSS})",
    "net_e4": f"sum({GROSS} * (100 - {DISCOUNT}))",
    "gross_n_c": f"sum(CASE WHEN l_returnflag = 'N' THEN {GROSS} ELSE 0 END)",
    "gross_a_c": f"sum(CASE WHEN l_returnflag = 'A' THEN {GROSS} ELSE 0 END)",
    "gross_big_c": f"sum(CASE WHEN l_quantity >= 48 THEN {GROSS} ELSE 0 END)",
    "disc_p": f"sum({DISCOUNT})",
    "tax_p": f"sum({TAX})",
    "tax_short_p": f"sum(CASE WHEN l_linenumber <= 2 THEN {TAX} ELSE 0 END)",
    "n_short": "count_if(l_linenumber <= 2)",
    "tax_mid_p": f"sum(CASE WHEN l_linenumber <= 4 THEN {TAX} ELSE 0 END)",
    "n_mid": "count_if(l_linenumber <= 4)",
    "tax_core_p": f"sum(CASE WHEN l_returnflag <> 'R' THEN {TAX} ELSE 0 END)",
    "n_core": "count_if(l_returnflag <> 'R')",
    "qty": "sum(CAST(l_quantity AS BIGINT))",
}
ORDER_MEASURES = {
    "n_orders": "count(*)",
    "price_c": f"sum({PRICE})",
    "price_open_c": f"sum(CASE WHEN o_orderstatus = 'O' THEN {PRICE} ELSE 0 END)",
    "n_low": "count_if(o_orderpriority = '5-LOW')",
    "n_unspecified": "count_if(o_orderpriority = '4-NOT SPECIFIED')",
    "n_low_filled": "count_if(o_orderpriority = '5-LOW' AND o_orderstatus = 'F')",
    "n_pending": "count_if(o_orderstatus = 'P')",
}
MEASURES = [*ORDER_MEASURES, *LINE_MEASURES]


def _resum(names: list[str]) -> list[Column]:
    return _aggregates({m: f"sum({m})" for m in names})


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: additive line measures."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*_aggregates(LINE_MEASURES))


def customer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and month with every additive measure."""
    orders = table(spark, sf_dir, "orders")
    month = period_start(F.col("o_orderdate"), "month").alias("period_start")
    return orders.join(order_lines(spark, sf_dir), "o_orderkey", "left").groupBy("o_custkey", month).agg(
        *_aggregates(ORDER_MEASURES), *_resum(list(LINE_MEASURES)))


def monthly_cube(spark: SparkSession, sf_dir: str, entity: str = "nation") -> DataFrame:
    """``(entity, period_start)`` plus additive measures. ``entity`` is nation, region, segment or customer."""
    months = customer_months(spark, sf_dir)
    if entity == "customer":
        return months.withColumnRenamed("o_custkey", "entity")
    customer = table(spark, sf_dir, "customer")
    label = {"nation": "n_name", "region": "r_name", "segment": "c_mktsegment"}[entity]
    if entity in ("nation", "region"):
        nation = table(spark, sf_dir, "nation")
        if entity == "region":
            region = table(spark, sf_dir, "region")
            nation = nation.join(region, nation.n_regionkey == region.r_regionkey)
        # nation and region hold a fixed 25 and 5 rows; Spark's own size check turns these joins into broadcasts
        customer = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    customer = customer.select("c_custkey", F.col(label).alias("entity"))
    return months.join(customer, months.o_custkey == customer.c_custkey).groupBy("entity", "period_start").agg(*_resum(MEASURES))


def roll_up(cube: DataFrame, grain: str) -> DataFrame:
    """Re-aggregate the monthly cube; all its measures are additive."""
    return cube.groupBy("entity", F.trunc("period_start", grain).alias("period_start")).agg(
        *_resum(MEASURES)
    )


def roll_up_mixed(cube: DataFrame, grains: tuple[str, ...] = ("month", "quarter")) -> DataFrame:
    """The cube at several grains in one pass: each month is expanded to the periods it belongs to, then re-aggregated.

    One table with a grain column lets a query over monthly and quarterly pillars use conditional aggregates instead of
    a join of two roll-ups, which would read the orders twice.
    """
    periods = F.explode(F.array(*[
        F.struct(F.lit(g).alias("grain"), F.trunc("period_start", g).alias("start")) for g in grains
    ]))
    spread = cube.withColumn("_period", periods)
    return spread.groupBy("entity", F.col("_period.grain").alias("grain"), F.col("_period.start").alias("period_start")).agg(
        *_resum(MEASURES)
    )


def _keyed(df: DataFrame, grain: str, columns: dict[str, str]) -> DataFrame:
    return df.select("entity", "period_start", period_key(F.col("period_start"), grain).alias("date_key"), *_aggregates(columns))


RETURNED = "(gross_c - gross_n_c - gross_a_c)"
GDP = {
    "nominal_gdp": "gross_c / 100.0D",
    "real_gdp": "net_e4 / 10000.0D",
    "gdp_growth_yoy": "(net_e4 / 10000.0D - lag(net_e4 / 10000.0D, 4) OVER (PARTITION BY {series} ORDER BY period_start))"
                      " / nullif(lag(net_e4 / 10000.0D, 4) OVER (PARTITION BY {series} ORDER BY period_start), 0) * 100.0D",
    "gdp_growth_qoq": "(net_e4 / 10000.0D - lag(net_e4 / 10000.0D, 1) OVER (PARTITION BY {series} ORDER BY period_start))"
                      " / nullif(lag(net_e4 / 10000.0D, 1) OVER (PARTITION BY {series} ORDER BY period_start), 0) * 100.0D",
    "gdp_per_capita": "net_e4 / 10000.0D / n_orders",
}
BALANCE = f"(20.0D * (gross_n_c - {RETURNED}) / nullif(gross_c, 0))"
PUBLIC_DEBT = {
    "total_debt": "price_c / 100.0D",
    "debt_to_gdp_ratio": "100.0D * price_c / nullif(gross_c, 0)",
    "budget_deficit": BALANCE,
    "budget_deficit_annual": f"CASE WHEN count({BALANCE}) OVER (PARTITION BY {{series}} ORDER BY period_start ROWS 3 PRECEDING) >= 4"
                             f" THEN avg({BALANCE}) OVER (PARTITION BY {{series}} ORDER BY period_start ROWS 3 PRECEDING) END",
    "external_debt_share_estimated": "100.0D * price_open_c / nullif(price_c, 0)",
}
MONTHLY = {
    "unemployment_rate": "100.0D * n_low / n_orders",
    "youth_unemployment_rate": "100.0D * (n_low + n_unspecified) / n_orders",
    "long_term_unemployment_rate": "100.0D * n_low_filled / n_orders",
    "labour_force_participation_rate": "100.0D * (n_orders - n_pending) / n_orders",
    "total_credit": "gross_c / 100.0D",
    "credit_nfc": "gross_n_c / 100.0D",
    "credit_households": "gross_a_c / 100.0D",
    "npl_ratio": "100.0D * gross_big_c / nullif(gross_c, 0)",
    "ecb_main_refinancing_rate": "4.0D * (CAST(disc_p AS DOUBLE) / nullif(n_lines, 0)) - 18.0D",
    "euribor_3m": "CAST(tax_short_p AS DOUBLE) / nullif(n_short, 0)",
    "euribor_6m": "CAST(tax_mid_p AS DOUBLE) / nullif(n_mid, 0)",
    "euribor_12m": "CAST(tax_p AS DOUBLE) / nullif(n_lines, 0)",
    "portugal_10y_bond_yield": "CAST(qty AS DOUBLE) / nullif(n_lines * 5, 0)",
    "hicp": "3.0D * (CAST(tax_p AS DOUBLE) / nullif(n_lines, 0)) - 10.0D",
    "cpi_estimated": "3.0D * (CAST(tax_mid_p AS DOUBLE) / nullif(n_mid, 0)) - 10.0D",
    "core_inflation": "3.0D * (CAST(tax_core_p AS DOUBLE) / nullif(n_core, 0)) - 10.0D",
}


def quarterly_text(series: str = "entity") -> dict[str, str]:
    return {name: text.format(series=series) for name, text in (GDP | PUBLIC_DEBT).items()}


class Warehouse:
    """The six pillar facts plus the labelled periods that go with them.

    Build it from the order tables with ``economy``, or from six fact DataFrames with ``from_facts``. Facts are lazy: a
    query reads only the columns it names, down to the scan. Pillars of one grain are columns of one table (``monthly``,
    ``quarterly``), and ``mixed`` holds both grains with a ``grain`` column, so that a query over several pillars still
    passes over the raw tables once. Each of the three is built on first use.
    """

    def __init__(self, monthly: Build, quarterly: Build, mixed: Build, periods=PERIODS, crisis_windows=CRISIS_WINDOWS,
                 phillips_periods=PHILLIPS_PERIODS) -> None:
        self._builders = {"monthly": monthly, "quarterly": quarterly, "mixed": mixed}
        self.periods, self.crisis_windows, self.phillips_periods = periods, crisis_windows, phillips_periods

    @cached_property
    def monthly(self) -> DataFrame:
        return self._builders["monthly"]()

    @cached_property
    def quarterly(self) -> DataFrame:
        return self._builders["quarterly"]()

    @cached_property
    def mixed(self) -> DataFrame:
        return self._builders["mixed"]()

    def shared(self, *columns: str) -> "Warehouse":
        """The same warehouse with the named columns of its panel written once to the checkpoint folder; a query names all it needs.

        For plans with several branches over the facts: they then read a few thousand panel rows instead of running the
        pass over the raw tables once per branch. The panel survives the loss of executors.
        """
        ensure_checkpoint_dir(self.mixed.sparkSession)
        panel = self.mixed.select("entity", "grain", "period_start", "date_key", *columns).checkpoint()

        def of(grain: str) -> DataFrame:
            return panel.where(F.col("grain") == grain).drop("grain")

        return Warehouse(lambda: of("month"), lambda: of("quarter"), lambda: panel, self.periods, self.crisis_windows, self.phillips_periods)

    def fact(self, pillar: str) -> DataFrame:
        spec = PILLARS[pillar]
        wide = self.monthly if spec.grain == "month" else self.quarterly
        return wide.select("entity", "period_start", "date_key", *spec.columns)

    @classmethod
    def from_facts(cls, facts: dict[str, DataFrame], periods=ECONOMIC_PERIODS, crisis_windows=registry_windows,
                   phillips_periods=registry_phillips) -> "Warehouse":
        """Bring pillar facts of one grain together on their key; used with facts that were loaded rather than derived."""
        keys = ["entity", "period_start", "date_key"]

        def wide(grain: str) -> DataFrame:
            parts = [facts[k].select(*keys, *p.columns) for k, p in PILLARS.items() if p.grain == grain and k in facts]
            return outer_merge(parts, keys)

        def mixed() -> DataFrame:
            labelled = [wide(g).withColumn("grain", F.lit(g)) for g in ("month", "quarter")]
            return labelled[0].unionByName(labelled[1], allowMissingColumns=True)

        return cls(lambda: wide("month"), lambda: wide("quarter"), mixed, periods, crisis_windows, phillips_periods)


def mixed_grain(cube: DataFrame) -> DataFrame:
    start = F.col("period_start")
    key = F.when(F.col("grain") == "month", period_key(start, "month")).otherwise(period_key(start, "quarter"))
    monthly = {name: f"CASE WHEN grain = 'month' THEN {text} END" for name, text in MONTHLY.items()}
    quarterly = {name: f"CASE WHEN grain = 'quarter' THEN {text} END" for name, text in quarterly_text("entity, grain").items()}
    return roll_up_mixed(cube).select("entity", "grain", "period_start", key.alias("date_key"), *_aggregates(monthly), *_aggregates(quarterly))


def economy(spark: SparkSession, sf_dir: str, entity: str = "nation") -> Warehouse:
    """The stand-in economies of the order tables."""

    def cube() -> DataFrame:
        return monthly_cube(spark, sf_dir, entity)

    return Warehouse(
        lambda: _keyed(cube(), "month", MONTHLY),
        lambda: _keyed(roll_up(cube(), "quarter"), "quarter", quarterly_text()),
        lambda: mixed_grain(cube()),
    )


def to_panel(wide: DataFrame, columns: list[str], keep: tuple[str, ...] = ("entity", "period_start")) -> DataFrame:
    """Wide fact to the long canonical form ``entity, period_start, indicator, value``."""
    return wide.unpivot(list(keep), columns, "indicator", "value")
