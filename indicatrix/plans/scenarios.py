"""Scenarios on the stand-in economies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from indicatrix.functions.numeric import rounded
from indicatrix.operators import scenario as sc
from indicatrix.plans.economy import economy


CALIBRATED = ["unemployment_rate", "gdp_growth_yoy", "total_credit", "euribor_12m"]


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mixed = economy(spark, sf_dir).shared(*dict.fromkeys([*sc.LATEST_MONTHLY, *sc.LATEST_QUARTERLY, *CALIBRATED])).mixed
    return sc.baseline(mixed), sc.calibrate(mixed)


def scenario_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.baseline(economy(spark, sf_dir).mixed).withColumn("annual_gdp", rounded("annual_gdp"))


def scenario_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.calibrate(economy(spark, sf_dir).shared(*CALIBRATED).mixed)
    return out.withColumns({"okun": rounded("okun", 4), "credit_elasticity": rounded("credit_elasticity", 4)})


def scenario_rate_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.rate_shock(*_both(spark, sf_dir), (100.0, 200.0))


def scenario_output_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.output_shock(*_both(spark, sf_dir), (-2.0, -4.0))


def scenario_inflation_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.inflation_shock(sc.baseline(economy(spark, sf_dir).mixed), (4.0, 6.0))


def scenario_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.consolidation(sc.baseline(economy(spark, sf_dir).mixed), (-1.0, 8.0))


def scenario_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.combined(*_both(spark, sf_dir))


def scenario_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined stress test with its parts."""
    return sc.report(*_both(spark, sf_dir))


QUERIES = {f.__name__: f for f in (scenario_baseline, scenario_coefficients, scenario_rate_shock, scenario_output_shock, scenario_inflation_shock,
                                   scenario_consolidation, scenario_combined, scenario_report)}
