"""Peer benchmark over a long panel ``entity, indicator, year, value, lower_is_better``: all entities at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from indicatrix.functions.bands import band
from indicatrix.functions.numeric import rounded
from indicatrix.operators.ranking import rank_peers, score_peers

CONVERGENCE = ([(">=", 3, "broadly converging"), (">=", 2, "mixed signals")], "broadly diverging")


def peer_average(panel: DataFrame) -> DataFrame:
    return panel.groupBy("indicator", "year").agg(F.avg("value").alias("average"), F.count("*").alias("n_peers"))


def with_gap(panel: DataFrame, average: DataFrame | None = None) -> DataFrame:
    """Gap to the comparison value of the same indicator and year: a given one, or the mean of all peers."""
    average = F.broadcast(peer_average(panel)) if average is None else average  # one row for each indicator and year
    return panel.join(average, ["indicator", "year"]).withColumn("gap", F.col("value") - F.col("average"))


def _series_fit(gaps: DataFrame, window: int, *kept: Column) -> DataFrame:
    """Per series: years and slope of the last ``window`` years, the trend they make, and further aggregates (which may use _k, 1 for the last year)."""
    back = F.row_number().over(Window.partitionBy("entity", "indicator").orderBy(F.desc("year")))
    recent = gaps.withColumn("_k", back).where(F.col("_k") <= window)
    position = (-F.col("_k")).cast("double")
    fit = recent.groupBy("entity", "indicator").agg(F.count("*").alias("n_years"), F.regr_slope(F.abs("gap"), position).alias("slope"), *kept)
    label = F.when(F.col("n_years") < 2, "insufficient_data").when(F.col("slope") > 0, "diverging").otherwise("converging")
    return fit.withColumn("trend", label).withColumn("convergence_rate", F.when(F.col("n_years") < 2, 0.0).otherwise(rounded("slope", 3)))


def convergence(gaps: DataFrame, window: int = 5) -> DataFrame:
    """Slope of the absolute gap over the last ``window`` years of each series: shrinking is converging."""
    return _series_fit(gaps, window).select("entity", "indicator", "n_years", "trend", "convergence_rate")


def latest_year(panel: DataFrame) -> DataFrame:
    """Rows of the newest year. The year is found by an aggregation and joined back as one row."""
    newest = panel.agg(F.max("year").alias("year"))
    return panel.join(F.broadcast(newest), "year")  # one row


def compare(panel: DataFrame, window: int = 5, ranker: Callable[..., DataFrame] = rank_peers) -> DataFrame:
    """Value, rank, gap to the average and trend in the newest year of the panel, of every entity and indicator that has it.

    Averages and the newest year are one small table; a series' last row and its trend come from one aggregation. For peer groups of any size pass
    ``number_large_groups`` as ``ranker``.
    """
    average = peer_average(panel)
    newest = Window.partitionBy()  # over one row for each indicator and year
    gaps = with_gap(panel, F.broadcast(average.withColumn("newest", F.max("year").over(newest))))
    last = [F.max(F.when(F.col("_k") == 1, F.col(c))).alias(c) for c in ("year", "value", "gap", "n_peers", "lower_is_better", "newest")]
    latest = _series_fit(gaps, window, *last).where("year = newest").drop("newest")
    ranked = ranker(latest, ["indicator", "year"], lower_is_better=F.col("lower_is_better"))
    return ranked.select("entity", "indicator", "year", rounded("value", 4).alias("value"), "rank", "n_peers", rounded("gap").alias("gap_to_average"), "trend", "convergence_rate")


def convergence_overview(compared: DataFrame) -> DataFrame:
    """How many indicators of each entity converge, with an overall label."""
    counts = compared.groupBy("entity").agg(F.count_if(F.col("trend") == "converging").alias("converging_count"),
                                            F.count_if(F.col("trend") != "converging").alias("diverging_count"))
    return counts.withColumn("overall_assessment", band("converging_count", CONVERGENCE))


def peer_pivot(panel: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Indicator rows by entity columns for the newest year, with the peer average; the columns are named up front."""
    newest = latest_year(with_gap(panel))
    return newest.groupBy("indicator").agg(
        *[rounded(F.max(F.when(F.col("entity") == e, F.col("value"))), 4).alias(e) for e in entities], rounded(F.first("average"), 4).alias("AVG"))


def rank_history(panel: DataFrame, focal: str | None = None, ranker: Callable[..., DataFrame] = rank_peers) -> DataFrame:
    """Rank in every year, of all entities or one; ``ranker`` as in ``compare``."""
    ranked = ranker(with_gap(panel), ["indicator", "year"], lower_is_better=F.col("lower_is_better"))
    if focal is not None:
        ranked = ranked.where(F.col("entity") == focal)
    return ranked.select("entity", "indicator", "year", rounded("value", 4).alias("value"), "rank", F.col("n_peers").alias("total_peers"))


def key_findings(compared: DataFrame, strong: float = 0.5) -> DataFrame:
    """Best and worst rank, largest gap and strongly converging indicators of each entity."""
    size = F.abs("gap_to_average")
    out = compared.groupBy("entity").agg(
        F.min_by("indicator", F.struct("rank", "indicator")).alias("best_indicator"), F.min("rank").alias("best_rank"),
        F.min_by("indicator", F.struct(-F.col("rank"), F.col("indicator"))).alias("worst_indicator"), F.max("rank").alias("worst_rank"),
        F.max_by("indicator", F.struct(size, F.col("indicator"))).alias("largest_gap_indicator"), F.max(size).alias("largest_gap"),
        F.max_by("gap_to_average", F.struct(size, F.col("indicator"))).alias("_signed"),
        F.count_if((F.col("trend") == "converging") & (F.abs("convergence_rate") > strong)).alias("n_strong_convergence"))
    return out.withColumn("gap_direction", F.when(F.col("_signed") > 0, "above").otherwise("below")).drop("_signed")


def radar(panel: DataFrame) -> DataFrame:
    """0-100 score of each entity and indicator in the newest year, higher is better."""
    scored = score_peers(latest_year(panel), ["indicator"], lower_is_better=F.col("lower_is_better"))
    return scored.select("entity", "indicator", rounded("score", 1).alias("score"))
