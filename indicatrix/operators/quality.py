"""Data-quality checks. Each gives rows ``(check, pillar, status, affected_rows, details)``; counts come from one pass per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from indicatrix.functions.numeric import ratio, rounded
from indicatrix.operators.joins import small_table
from indicatrix.registry import PILLARS, Pillar
from indicatrix.sources.state import VersionedTable

COLUMNS = ["check", "pillar", "status", "affected_rows", "details"]
CHECK_SCHEMA = "check string, pillar string, status string, affected_rows bigint, details string"

# Column that must never be wholly empty, by pillar.
NEVER_EMPTY = {"gdp": "nominal_gdp", "unemployment": "unemployment_rate", "credit": "total_credit", "interest_rates": "euribor_3m",
               "inflation": "hicp", "public_debt": "total_debt"}


def _row(check: str, pillar: str, status: Column, affected: Column, details: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(pillar).alias("pillar"), status.alias("status"),
                    affected.cast("bigint").alias("affected_rows"), details.alias("details"))


def _rows(one: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return one.select(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def check_schema(df: DataFrame, pillar: str) -> DataFrame:
    """Expected columns against the columns there are; decided from the schema, nothing is read."""
    missing = sorted(set(PILLARS[pillar].columns) - set(df.columns))
    status, details = ("fail", f"lacks {missing}") if missing else ("pass", "no column is lacking")
    return df.sparkSession.createDataFrame([(f"schema_{pillar}", pillar, status, 0, details)], CHECK_SCHEMA)


def check_values(df: DataFrame, pillars: Sequence[Pillar]) -> DataFrame:
    """Not-null, plausible-range and freshness checks of several pillars held in one table, in one aggregation."""
    ranges = [(p, i) for p in pillars for i in p.indicators if i.plausible_low is not None and i.name in df.columns]
    aggregates = [F.count("*").alias("n"), F.max("date_key").alias("newest")]
    aggregates += [F.count_if(F.col(NEVER_EMPTY[p.key]).isNull()).alias(f"null_{p.key}") for p in pillars]
    for _, i in ranges:
        outside = (F.col(i.name) < i.plausible_low) | (F.col(i.name) > i.plausible_high)
        aggregates += [F.count_if(outside).alias(f"out_{i.name}"), F.count(i.name).alias(f"known_{i.name}"),
                       F.min(i.name).alias(f"min_{i.name}"), F.max(i.name).alias(f"max_{i.name}")]
    one = df.agg(*aggregates)
    rows = []
    for p in pillars:
        c, empty = NEVER_EMPTY[p.key], F.col(f"null_{p.key}")
        rows.append(_row(f"not_null_{p.key}_{c}", p.key, F.when(empty == F.col("n"), "fail").when(empty > 0, "warn").otherwise("pass"), empty,
                         F.format_string("%d nulls", empty)))
    for p, i in ranges:
        out = F.col(f"out_{i.name}")
        rows.append(_row(f"range_{p.key}_{i.name}", p.key, F.when(F.col(f"known_{i.name}") == 0, "skip").when(out > 0, "warn").otherwise("pass"), out,
                         F.format_string(f"%d values outside [{i.plausible_low}, {i.plausible_high}]", out)))
    return _rows(one, rows).where("status <> 'skip'")


def range_extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Actual minimum and maximum of each column."""
    one = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    return _rows(one, [F.struct(F.lit(c).alias("indicator"), F.col(f"lo_{c}").alias("actual_min"), F.col(f"hi_{c}").alias("actual_max")) for c in columns])


def check_freshness(df: DataFrame, pillars: Sequence[Pillar], end: int | DataFrame) -> DataFrame:
    """The newest key of pillars held in one table against the year that should be there: a number, or one row with end_year."""
    newest = df.agg(F.max("date_key").alias("newest"))
    one = newest.withColumn("end_year", F.lit(end)) if isinstance(end, int) else newest.join(F.broadcast(end))  # one row each
    fresh = F.col("newest").contains(F.col("end_year").cast("string"))
    return _rows(one, [_row(f"freshness_{p.key}", p.key, F.when(fresh, "pass").otherwise("warn"), F.lit(0), F.concat(F.lit("newest key "), F.col("newest"))) for p in pillars])


def check_completeness(df: DataFrame, pillars: Sequence[Pillar]) -> DataFrame:
    """Rows there are against series x periods, from the first period to the last, of pillars of one grain held in one table."""
    per_series = df.groupBy("entity").agg(F.count("*").alias("n"), F.min("period_start").alias("lo"), F.max("period_start").alias("hi"))
    one = per_series.agg(F.sum("n").alias("n"), F.count("*").alias("series"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    step = 1 if pillars[0].grain == "month" else 3
    expected = F.col("series") * (F.floor(F.months_between("hi", "lo") / step) + 1).cast("bigint")
    short = expected - F.col("n")
    return _rows(one, [_row(f"completeness_{p.key}", p.key, F.when(short > 0, "warn").otherwise("pass"), F.greatest(short, F.lit(0)), F.format_string("%d of %d rows", F.col("n"), expected))
                       for p in pillars])


def check_consistency(df: DataFrame) -> DataFrame:
    """Logical relations between columns of the monthly pillars, in one aggregation."""
    parts = F.coalesce("credit_nfc", F.lit(0.0)) + F.coalesce("credit_households", F.lit(0.0))
    both = F.col("hicp").isNotNull() & F.col("cpi_estimated").isNotNull()
    rules = [
        ("consistency_credit_components", "credit", F.count_if(parts > F.col("total_credit") * 1.01)),
        ("consistency_youth_unemp", "unemployment", F.count_if(F.col("youth_unemployment_rate") < F.col("unemployment_rate"))),
        ("consistency_euribor_term", "interest_rates", F.count_if(F.col("euribor_3m") > F.col("euribor_12m") + 0.1)),
        ("consistency_hicp_cpi", "inflation", F.when((F.count_if(both) > 0) & (F.count_if(both & (F.col("hicp") != F.col("cpi_estimated"))) == 0),
                                                     F.count_if(both)).otherwise(0)),
    ]
    one = df.agg(*[c.alias(name) for name, _, c in rules])
    return _rows(one, [_row(name, pillar, F.when(F.col(name) > 0, "warn").otherwise("pass"), F.col(name), F.format_string("%d violations", F.col(name)))
                       for name, pillar, _ in rules])


def outliers(panel: DataFrame, by: Sequence[str] = ("entity", "indicator"), value: str = "value", threshold: float = 3.0, min_n: int = 10) -> DataFrame:
    """Values further than ``threshold`` sample deviations from their series' mean; short and flat series are skipped."""
    series = Window.partitionBy(*by)
    n, std = F.count(value).over(series), F.stddev_samp(value).over(series)
    z = F.when((n >= min_n) & (std > 0), F.abs((F.col(value) - F.avg(value).over(series)) / F.when(std > 0, std)))
    return panel.where(F.col(value).isNotNull()).withColumn("z", z).where(F.col("z") > threshold)


def outlier_report(panel: DataFrame, by: Sequence[str] = ("entity", "indicator"), threshold: float = 3.0) -> DataFrame:
    return outliers(panel, by, threshold=threshold).groupBy("indicator").agg(F.count("*").alias("n_outliers"), rounded(F.max("z"), 4).alias("max_z"))


def baseline_stats(panel: DataFrame, by: Sequence[str] = ("entity", "indicator"), min_n: int = 10) -> DataFrame:
    """Mean, deviation and median of each series: the table a later run compares itself with."""
    return panel.groupBy(*by).agg(F.count("value").alias("n"), rounded(F.avg("value"), 4).alias("mean"), rounded(F.stddev_samp("value"), 4).alias("std"), rounded(F.median("value"), 4).alias("median")).where(
        F.col("n") >= min_n)


def drift(current: DataFrame, baseline: DataFrame, by: Sequence[str] = ("entity", "indicator"), threshold: float = 0.25) -> DataFrame:
    """Relative change of mean and deviation against a baseline; beyond the threshold is a warning, no baseline a first run."""
    before = baseline.select(*by, F.col("mean").alias("mean_before"), F.col("std").alias("std_before"))
    both = current.join(before, list(by), "left")
    def moved(c: str) -> Column:
        was = F.col(f"{c}_before")
        return F.when(F.abs(was) > 0.01, ratio(F.abs(F.col(c) - was), F.abs(was)))
    worst = F.greatest(F.coalesce(moved("mean"), F.lit(0.0)), F.coalesce(moved("std"), F.lit(0.0)))
    return both.select(*by, "mean", "std", "mean_before", "std_before", rounded(moved("mean"), 4).alias("mean_change"),
                       rounded(moved("std"), 4).alias("std_change"),
                       F.when(F.col("mean_before").isNull(), "baseline").when(worst > threshold, "warn").otherwise("pass").alias("status"))


def drift_run(panel: DataFrame, state: VersionedTable, by: Sequence[str] = ("entity", "indicator"), threshold: float = 0.25) -> DataFrame:
    """One batch run: the panel's statistics against the newest complete baseline, and then stored as the next one.

    The report reads the baseline's own version, so it stays what it was when later runs commit theirs. A run that breaks before its commit leaves the baseline as it is.
    """
    before = state.read()
    current = state.read(state.commit(baseline_stats(panel, by)))
    baseline = current.limit(0) if before is None else before
    return drift(current, baseline, by, threshold)


def roll_up(checks: DataFrame) -> DataFrame:
    """Totals by status, and whether the gate would block."""
    return checks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "warn").alias("warnings"),
                      F.count_if(F.col("status") == "fail").alias("failures")).withColumn("blocks", F.col("failures") > 0)


class QualityGateError(RuntimeError):
    """A failing check stopped the load."""


def gate(checks: DataFrame, fail_on_error: bool = True) -> DataFrame:
    """Raise when a check failed and failures block. Reads one row to the driver."""
    summary = roll_up(checks)
    if fail_on_error and summary.first()["blocks"]:
        raise QualityGateError("data quality checks failed; see the report rows with status 'fail'")
    return summary


def report_document(checks: DataFrame, run_id: str, batch: int = 1000) -> DataFrame:
    """Nested report rows for a JSON sink. The check list is set by the registry, not by the data."""
    rows = F.array_sort(F.collect_list(F.struct(*COLUMNS)))
    return checks.agg(F.struct(F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passed"),
                               F.count_if(F.col("status") == "warn").alias("warnings"), F.count_if(F.col("status") == "fail").alias("failures")).alias("summary"),
                      rows.alias("checks")).withColumn("run_id", F.lit(run_id))


# ---- alerts -------------------------------------------------------------------------------------------------------

def alert_rules(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    return small_table(spark, rules, "indicator string, description string, severity string, side string, threshold double")


def check_thresholds(latest: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts on latest values ``(entity, indicator, period_start, value)``: strictly beyond a threshold. Both severities may fire."""
    beyond = ((F.col("side") == "above") & (F.col("value") > F.col("threshold"))) | ((F.col("side") == "below") & (F.col("value") < F.col("threshold")))
    return latest.join(rules, "indicator").where(beyond)


def severity_order(severity: Column | str = "severity") -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.when(c == "critical", 0).when(c == "warning", 1).otherwise(2)


def alert_counts(alerts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return alerts.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"),
                                   F.count_if(F.col("severity") == "warning").alias("warning"))
