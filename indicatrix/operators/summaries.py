"""Summaries of series: descriptive statistics, trends, peaks, period and latest-value reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from indicatrix.functions.bands import band
from indicatrix.functions.numeric import pct_change, ratio, rounded
from indicatrix.operators.joins import label_periods
from indicatrix.operators.windows import by_series

LONG = ("entity", "indicator")
HALF_SPLIT = ([(">", 5.0, "increasing"), ("<", -5.0, "decreasing")], "stable")
MOMENTUM_GAP = ([(">", 1.0, "above trend"), ("<", -1.0, "below trend")], "near trend")


def _moments(value: str, digits: int) -> list[Column]:
    v = F.col(value)
    n, spread = F.count(v), F.stddev_pop(v)
    skew = F.when((n > 2) & (spread > 1e-12), F.skewness(v) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).when(n > 2, 0.0)
    return [n.alias("count"), rounded(F.avg(v), digits).alias("mean"), rounded(F.when(n > 1, F.stddev_samp(v)), digits).alias("std"), rounded(F.min(v), digits).alias("min"),
            rounded(F.max(v), digits).alias("max"), rounded(skew, digits).alias("skewness")]


DESCRIBED = ["count", "mean", "median", "std", "min", "max", "skewness"]


def describe(panel: DataFrame, by: Sequence[str] = LONG, value: str = "value", digits: int = 4) -> DataFrame:
    """count, mean, median, sample std, min, max and bias-corrected skewness, each null below its minimum count.

    For series: a group's distinct values, one for each period, lie in one buffer for the median. See ``describe_large`` for groups of raw rows.
    """
    return panel.groupBy(*by).agg(*_moments(value, digits), rounded(F.percentile(F.col(value), F.lit(0.5)), digits).alias("median")).select(*by, *DESCRIBED)


def describe_large(rows: DataFrame, by: Sequence[str] = LONG, value: str = "value", digits: int = 4, bins: int = 4096) -> DataFrame:
    """The same statistics, exact too, of groups that no task could hold."""
    return rows.groupBy(*by).agg(*_moments(value, digits)).join(exact_median(rows, by, value, bins), list(by)).select(*by, *[rounded(c, digits).alias(c) if c == "median" else c for c in DESCRIBED])


def exact_median(rows: DataFrame, by: Sequence[str], value: str = "value", bins: int = 4096) -> DataFrame:
    """The median of each group by rank: equal values are counted first, a histogram of ``bins`` bins says where the middle lies, and only those bins are ordered."""
    by, v = list(by), F.col(value)
    counts = rows.where(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_c"))
    span = counts.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    binned = counts.join(span, by).withColumn("_bin", place)
    histogram = binned.groupBy(*by, "_bin").agg(F.sum("_c").alias("_in"), F.first("_n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bins
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = histogram.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))) \
        .where((low >= F.col("_before")) & (low < F.col("_before") + F.col("_in")) | (high >= F.col("_before")) & (high < F.col("_before") + F.col("_in"))) \
        .select(*by, "_bin", "_before")
    within = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(middle, [*by, "_bin"]).withColumn("_first", F.col("_before") + F.coalesce(F.sum("_c").over(within), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_c")), F.col("_v")))

    return ranked.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"))


def half_split(panel: DataFrame, by: Sequence[str] = LONG, period: str = "year", value: str = "value") -> DataFrame:
    """Mean of the second half of a series against the first, and its trend class (beyond 5 % either way)."""
    numbered = panel.withColumn("_i", F.row_number().over(by_series(by, period))).withColumn(
        "_n", F.count("*").over(Window.partitionBy(*by)))
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    halves = numbered.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(F.when(first, F.col(value))).alias("first_half"), F.avg(F.when(~first, F.col(value))).alias("second_half"))
    shift = F.coalesce(ratio(F.col("second_half") - F.col("first_half"), F.abs("first_half")) * 100.0, F.lit(0.0))
    return halves.withColumn("pct_shift", shift).select(
        *by, "n", rounded("pct_shift").alias("pct_shift_halves"),
        F.when(F.col("n") < 4, "insufficient_data").otherwise(band("pct_shift", HALF_SPLIT)).alias("trend"))


def crisis_summary(panel: DataFrame, windows: Sequence[tuple[str, int, int]], by: Sequence[str] = LONG, year: str = "year",
                   value: str = "value", digits: int = 4) -> DataFrame:
    """Mean, minimum and maximum of each series inside labelled windows."""
    labelled = label_periods(panel.where(F.col(value).isNotNull()), windows, year)
    return labelled.groupBy(*by, "period").agg(
        F.count("*").alias("n"), rounded(F.avg(value), digits).alias("mean"), rounded(F.min(value), digits).alias("min"), rounded(F.max(value), digits).alias("max"))


def annual_means(panel: DataFrame, by: Sequence[str] = LONG, value: str = "value", period: str = "period_start") -> DataFrame:
    return panel.groupBy(*by, F.year(period).alias("year")).agg(F.avg(value).alias("value"))


def with_growth(annual: DataFrame, by: Sequence[str] = LONG, value: str = "value", period: str = "year") -> DataFrame:
    order = by_series(by, period)
    return annual.withColumn("growth_pct", pct_change(F.col(value), F.lag(value).over(order)))


def regimes(panel: DataFrame, by: Sequence[str] = ("entity",), value: str = "value", low: float = 1.0, high: float = 3.0) -> DataFrame:
    v = F.col(value)
    return panel.groupBy(*by).agg(F.count_if(v < low).alias("low"), F.count_if(v.between(low, high)).alias("moderate"), F.count_if(v > high).alias("high"))


def summarise(panel: DataFrame, windows: Sequence[tuple[str, int, int]], by: Sequence[str] = LONG) -> DataFrame:
    """One row per series from its annual means: ends, peak, trough, shift, momentum, volatility and crisis windows."""
    grown = with_growth(annual_means(panel, by), by)
    numbered = grown.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("year")))).withColumn(
        "_i", F.row_number().over(by_series(by, "year"))).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    v, g, year = F.col("value"), F.col("growth_pct"), F.col("year")
    growth_back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.when(g.isNotNull(), year))))
    numbered = numbered.withColumn("_gback", F.when(g.isNotNull(), growth_back))
    crises = []
    for i, (label, start, end) in enumerate(windows):
        inside = year.between(start, end)
        crises.append(F.struct(
            F.lit(label).alias("label"), F.avg(F.when(inside, v)).alias("mean_value"), F.avg(F.when(inside, g)).alias("mean_growth"),
            F.min(F.when(inside, v)).alias("min_value"), F.max(F.when(inside, v)).alias("max_value")).alias(f"_c{i}"))
    out = numbered.groupBy(*by).agg(
        F.min(year).alias("earliest_year"), F.max(year).alias("latest_year"), F.min_by(v, year).alias("earliest_value"),
        F.max_by(v, year).alias("latest_value"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("peak_value"),
        F.max_by(year, F.struct(v, -year)).alias("peak_year"), F.min(v).alias("trough_value"), F.min_by(year, F.struct(v, year)).alias("trough_year"),
        F.avg(F.when(first, v)).alias("_first"), F.avg(F.when(~first, v)).alias("_second"),
        F.max_by(g, F.when(g.isNotNull(), year)).alias("latest_growth"), F.avg(F.when(F.col("_gback") <= 3, g)).alias("recent_avg_growth"),
        F.avg(g).alias("longrun_avg_growth"), *crises)
    shift = F.coalesce(ratio(F.col("_second") - F.col("_first"), F.abs("_first")) * 100.0, F.lit(0.0))
    overall = F.coalesce(ratio(F.col("latest_value") - F.col("earliest_value"), F.abs("earliest_value")) * 100.0, F.lit(0.0))
    return out.withColumns({
        "pct_shift_halves": shift, "trend": band(shift, HALF_SPLIT), "overall_change_pct": overall,
        "momentum_gap": F.col("recent_avg_growth") - F.col("longrun_avg_growth"),
        "crisis_impacts": F.array(*[F.col(f"_c{i}") for i in range(len(windows))]),
    }).drop("_first", "_second", *[f"_c{i}" for i in range(len(windows))])


def latest_report(panel: DataFrame, by: Sequence[str] = LONG, value: str = "value", period: str = "period_start") -> DataFrame:
    """Latest known value and its date, with mean, minimum, maximum and sample std."""
    known = panel.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(
        F.max(period).alias("latest_period"), F.max_by(value, period).alias("latest"), rounded(F.avg(value), 4).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"), rounded(F.when(F.count(value) > 1, F.stddev_samp(value)), 4).alias("std"))


def null_report(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Row count, nulls per column and overall null share, in one aggregation."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    wide = df.groupBy(*by).agg(F.count("*").alias("n_rows"), *counts)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    with_total = wide.withColumn("null_pct", rounded(total * 100.0 / (F.col("n_rows") * len(columns)), 4))
    return with_total.unpivot([*by, "n_rows", "null_pct"], list(columns), "column_name", "n_null")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_n(panel: DataFrame, n: int, by: Sequence[str] = LONG, period: str = "period_start") -> DataFrame:
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(period)))
    return panel.withColumn("_k", back).where(F.col("_k") <= n).drop("_k")
