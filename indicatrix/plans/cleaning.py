"""Cleaning operators on the stand-in economies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from indicatrix.functions.keys import (parse_key, period_key, year_month_label, year_quarter_label)
from indicatrix.functions.numeric import minmax_score, rounded, share
from indicatrix.operators import clean
from indicatrix.operators.joins import small_table
from indicatrix.operators.windows import whole_series
from indicatrix.plans.economy import Warehouse, economy
from indicatrix.registry import PILLARS

MONTH_END, QUARTER_END = date(2001, 8, 1), date(2001, 7, 1)
FETCHED = "2001-09-15"


def raw_from(wh: Warehouse, pillar: str) -> DataFrame:
    """The pillar as its raw file has it: raw column names, a date, and year and quarter for quarterly data."""
    spec = PILLARS[pillar]
    back = {new: old for old, new in reversed(spec.rename.items())}
    fact = wh.fact(pillar)
    parts = [F.year("period_start").alias("year"), F.quarter("period_start").alias("quarter")]
    return fact.select("entity", F.col("period_start").alias("date"), *(parts if spec.grain == "quarter" else []),
                       *[F.col(c).alias(back.get(c, c)) for c in spec.columns if c != "budget_deficit_annual"])


def transform_raw(raw: DataFrame, pillar: str) -> DataFrame:
    end = QUARTER_END if PILLARS[pillar].grain == "quarter" else MONTH_END
    return clean.transform_pillar(raw, pillar, F.lit(FETCHED), F.lit(date(1995, 1, 1)), F.lit(end))


def _transform(pillar: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return transform_raw(raw_from(economy(spark, sf_dir), pillar), pillar)

    return run


def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("unemployment_rate", 10, 30), ("youth_unemployment_rate", 25, None), ("hicp", None, 2.5)]
    return clean.clip_report(economy(spark, sf_dir).monthly, rules)


def clip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = economy(spark, sf_dir).monthly.select("entity", "date_key", "npl_ratio", "hicp")
    return clean.clip_columns(monthly, [("npl_ratio", 3, 9), ("hicp", 0, None)])


def provisional_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch dates come from a metadata table; a pillar without one falls back to a fixed date."""
    meta = small_table(spark, [("credit", "2001-03-20"), ("inflation", None)], "pillar string, fetched_at string")
    panel = economy(spark, sf_dir).monthly.unpivot(["entity", "period_start"], ["total_credit", "hicp"], "indicator", "value")
    named = panel.withColumn("pillar", F.when(F.col("indicator") == "hicp", "inflation").otherwise("credit"))
    flagged = clean.flag_provisional(named.join(meta, "pillar"), "month", F.col("fetched_at"), date(2001, 2, 1))
    return flagged.groupBy("entity", "indicator").agg(
        F.count_if("is_provisional").alias("n_provisional"),
        F.min(F.when(F.col("is_provisional"), F.col("period_start"))).alias("first_provisional"))


def override_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = economy(spark, sf_dir).monthly.select("entity", "period_start", "ecb_main_refinancing_rate")
    masked = rates.withColumn("ecb_main_refinancing_rate", F.when(F.month("period_start") != 2, F.col("ecb_main_refinancing_rate")))
    return clean.override(masked, "ecb_main_refinancing_rate", 1.0, F.lit(date(1995, 1, 1)), F.lit(date(1997, 12, 1)))


def parts_within_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    credit = economy(spark, sf_dir).monthly.select(
        "entity", "date_key", (F.col("total_credit") * 0.6).alias("total_credit"), "credit_nfc", "credit_households")
    return clean.enforce_parts(credit, ("credit_nfc", "credit_households"), "total_credit")


def copied_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the entities publish a copy of the headline rate; those are flagged and shifted."""
    prices = economy(spark, sf_dir).monthly.where("hicp is not null").select("entity", "date_key", "hicp", "cpi_estimated")
    copied = prices.withColumn("cpi_estimated", F.when(F.col("entity") < "J", F.col("hicp")).otherwise(F.col("cpi_estimated")))
    return clean.mark_estimated_copy(copied, "hicp", "cpi_estimated", "cpi_is_estimated")


def timeseries_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.timeseries(economy(spark, sf_dir).fact("interest_rates"), 1996, 1998,
                            ["ecb_main_refinancing_rate", "euribor_12m"], limit=200)


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of three grains, back to dates, with display labels and sort order."""
    start = F.col("period_start")
    return economy(spark, sf_dir).monthly.select(
        "entity", "date_key", period_key(start, "quarter").alias("quarter_key"), period_key(start, "year").alias("year_key"),
        parse_key(F.col("date_key")).alias("from_month"), parse_key(period_key(start, "quarter")).alias("from_quarter"),
        parse_key(period_key(start, "year")).alias("from_year"), year_quarter_label(start).alias("year_quarter"),
        year_month_label(start).alias("year_month"), (F.year(start) * 100 + F.month(start)).alias("sort_order"))


def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-100 position within the series, inverted where lower is better; a flat series scores 50."""
    columns = {"unemployment_rate": True, "hicp": True, "labour_force_participation_rate": False}
    wide = economy(spark, sf_dir).monthly.withColumn("flat", F.lit(1.0))
    whole = whole_series()
    def score(c, invert):
        return rounded(minmax_score(F.col(c), F.min(c).over(whole), F.max(c).over(whole), invert), 1)
    return wide.select("entity", "date_key", *[score(c, i).alias(f"{c}_score") for c, i in columns.items()],
                       score("flat", False).alias("flat_score"))


def segment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each part in the total, and what remains, per market segment and quarter."""
    quarterly = economy(spark, sf_dir, "segment").monthly.groupBy("entity", F.trunc("period_start", "quarter").alias("period_start")).agg(
        *[F.sum(c).alias(c) for c in ("total_credit", "credit_nfc", "credit_households")])
    rest = F.col("total_credit") - F.col("credit_nfc") - F.col("credit_households")
    return quarterly.select(
        "entity", "period_start", rounded(share("credit_nfc", "total_credit")).alias("first_share_pct"),
        rounded(share("credit_households", "total_credit")).alias("second_share_pct"),
        rounded(share(rest, "total_credit")).alias("remainder_pct"))


QUERIES = {
    **{f"transform_{p}": _transform(p) for p in PILLARS},
    "clip_counts": clip_counts, "clip_values": clip_values, "provisional_flags": provisional_flags,
    "override_window": override_window, "parts_within_total": parts_within_total, "copied_series": copied_series,
    "timeseries_fetch": timeseries_fetch, "period_labels": period_labels, "minmax_scores": minmax_scores,
    "segment_shares": segment_shares,
}
