"""Briefing tables on the stand-in economies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from indicatrix.functions.numeric import rounded
from indicatrix.operators import briefing as br
from indicatrix.operators.summaries import latest_report, summarise
from indicatrix.plans.economy import Warehouse, economy, to_panel
from indicatrix.plans.statistics import PRIMARY

SECONDARY = ["youth_unemployment_rate", "long_term_unemployment_rate", "npl_ratio", "credit_households", "euribor_12m", "core_inflation", "cpi_estimated"]
KEYWORDS = [("youth", "youth"), ("long_term", "long-term"), ("npl", "credit quality"), ("household", "households"), ("euribor", "market rates"), ("core", "core prices"), ("cpi", "consumer prices")]


def _summary(wh: Warehouse) -> DataFrame:
    return summarise(to_panel(wh.mixed, PRIMARY).where("value is not null"), wh.crisis_windows)


def briefing_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = br.headline(_summary(economy(spark, sf_dir)))
    return out.select("entity", "indicator", "headline", "risk_level", "direction", "momentum", "trend", rounded("latest_value", 4).alias("latest_value"),
                      rounded("momentum_gap", 4).alias("momentum_gap"))


def briefing_crises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.crisis_impact(_summary(economy(spark, sf_dir)))


def briefing_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = latest_report(to_panel(economy(spark, sf_dir).monthly, SECONDARY))
    return br.secondary_findings(report, KEYWORDS).select("entity", "indicator", "topic", "position", "latest", "mean", "min", "max")


def briefing_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.relations(_summary(economy(spark, sf_dir)))


def briefing_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return br.overall_tone(br.headline(_summary(economy(spark, sf_dir))))


def briefing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest and peak values a narrative quotes."""
    mixed = economy(spark, sf_dir).mixed
    def latest(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("period_start"))).alias(f"latest_{c}")
    return mixed.groupBy("entity").agg(*[latest(c) for c in ("unemployment_rate", "debt_to_gdp_ratio", "budget_deficit", "npl_ratio", "hicp")],
                                       F.max("unemployment_rate").alias("peak_unemployment_rate"), F.max("debt_to_gdp_ratio").alias("peak_debt_to_gdp_ratio"))


def briefing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole briefing of each entity as one JSON text."""
    summary = _summary(economy(spark, sf_dir).shared(*PRIMARY))
    heads = br.headline(summary).withColumn("latest_value", rounded("latest_value", 2))
    doc = br.document(heads, br.relations(summary), br.overall_tone(heads))
    return doc.select("entity", "tone", F.size("pillar_insights").alias("n_insights"), F.size("cross_pillar_insights").alias("n_relations"),
                      F.to_json(F.struct("pillar_insights", "cross_pillar_insights", "n_high", "n_elevated", "tone")).alias("document"))


QUERIES = {f.__name__: f for f in (briefing_headlines, briefing_crises, briefing_secondary, briefing_relations, briefing_tone, briefing_facts, briefing_documents)}
