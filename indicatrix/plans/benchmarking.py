"""Peer benchmark over nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from indicatrix.functions.numeric import rounded
from indicatrix.operators import benchmark as bm
from indicatrix.operators.ranking import number_large_groups
from indicatrix.plans.economy import economy, table
from indicatrix.registry import BENCHMARK_INDICATORS

SOURCE = {"gdp_growth": "gdp_growth_yoy", "unemployment": "unemployment_rate", "inflation": "hicp", "debt_to_gdp": "debt_to_gdp_ratio",
          "interest_rate_10y": "portugal_10y_bond_yield"}
FOCAL = [f"NATION_{i}" for i in range(25)]  # the nation table has a fixed 25 rows


def benchmark_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual long panel of the five benchmark indicators."""
    wide = economy(spark, sf_dir).mixed.groupBy("entity", F.year("period_start").alias("year")).agg(
        *[rounded(F.avg(SOURCE[name]), 4).alias(name) for name, _, _ in BENCHMARK_INDICATORS])
    panel = wide.unpivot(["entity", "year"], list(SOURCE), "indicator", "value").where("value is not null")
    lower = [name for name, _, low in BENCHMARK_INDICATORS if low]
    return panel.withColumn("lower_is_better", F.col("indicator").isin(lower))


def peer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.compare(benchmark_panel(spark, sf_dir))


def convergence_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.convergence(bm.with_gap(benchmark_panel(spark, sf_dir)))


def convergence_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.convergence_overview(peer_comparison(spark, sf_dir))


def peer_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.peer_pivot(benchmark_panel(spark, sf_dir), FOCAL)


def rank_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.rank_history(benchmark_panel(spark, sf_dir), FOCAL[0])


def benchmark_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.key_findings(peer_comparison(spark, sf_dir))


def peer_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.radar(benchmark_panel(spark, sf_dir))


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual long panel of all customers: orders, of which the counts tie in masses, and low-priority share, where less is better."""
    orders = table(spark, sf_dir, "orders")
    wide = orders.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").cast("double").alias("orders"), rounded(F.avg(F.when(F.col("o_orderpriority") == "5-LOW", 100.0).otherwise(0.0)), 2).alias("low_share"))
    return wide.unpivot(["entity", "year"], ["orders", "low_share"], "indicator", "value").withColumn("lower_is_better", F.col("indicator") == "low_share")


def customer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as peers: a peer group has as many rows as there are customers."""
    return bm.compare(customer_panel(spark, sf_dir), ranker=number_large_groups)


def customer_rank_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.rank_history(customer_panel(spark, sf_dir), ranker=number_large_groups)


QUERIES = {f.__name__: f for f in (benchmark_panel, peer_comparison, convergence_trends, convergence_overview, peer_pivot, rank_history,
                                   benchmark_findings, peer_radar, customer_comparison, customer_rank_history)}
