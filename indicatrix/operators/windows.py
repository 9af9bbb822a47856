"""Window operators over panels.

Every window is partitioned by series (entity, or entity and indicator) and runs on rolled-up data, so a group holds
one row per period: its size is bounded by the calendar, whatever the size of the raw tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from indicatrix.functions.numeric import col, pct_change
from indicatrix.functions.keys import month_index
from indicatrix.operators.folds import series_array, smoothed

SERIES = ("entity",)
PERIOD = "period_start"


def by_series(series: Sequence[str] = SERIES, period: str = PERIOD) -> WindowSpec:
    return Window.partitionBy(*series).orderBy(period)


def whole_series(series: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*series)


def trailing(value: Column | str, k: int, fn: Callable[[Column], Column] = F.avg, min_obs: int = 1,
             series: Sequence[str] = SERIES, period: str = PERIOD) -> Column:
    """Aggregate of the last k rows; null until ``min_obs`` non-null rows are in the frame."""
    frame = by_series(series, period).rowsBetween(1 - k, 0)
    out = fn(col(value)).over(frame)
    return out if min_obs <= 1 else F.when(F.count(col(value)).over(frame) >= min_obs, out)


def lagged(value: Column | str, k: int = 1, series: Sequence[str] = SERIES, period: str = PERIOD) -> Column:
    return F.lag(col(value), k).over(by_series(series, period))


def change(value: Column | str, k: int = 1, kind: str = "pp", series: Sequence[str] = SERIES,
           period: str = PERIOD) -> Column:
    """Point ("pp") or percentage ("pct") change against k rows back."""
    now, before = col(value), lagged(value, k, series, period)
    return now - before if kind == "pp" else pct_change(now, before)


def cumulative_index(rate_pct: Column | str, base: float = 100.0, series: Sequence[str] = SERIES,
                     period: str = PERIOD) -> Column:
    """Compounded level: base * exp(running sum of ln(1 + rate))."""
    running = by_series(series, period).rowsBetween(Window.unboundedPreceding, 0)
    return base * F.exp(F.sum(F.ln(1.0 + col(rate_pct) / 100.0)).over(running))


def calendar_average(value: Column | str, months: int, series: Sequence[str] = SERIES, period: str = PERIOD) -> Column:
    """Average over the last ``months`` calendar months (by date, so a gap shortens the frame instead of stretching it)."""
    frame = Window.partitionBy(*series).orderBy(month_index(F.col(period))).rangeBetween(1 - months, 0)
    return F.avg(col(value)).over(frame)


def same_period_last_year(df: DataFrame, value: str, out: str, series: Sequence[str] = SERIES,
                          period: str = PERIOD) -> DataFrame:
    """Attach the value one calendar year earlier: a range window of exactly one month index, no self-join."""
    at = Window.partitionBy(*series).orderBy(month_index(F.col(period))).rangeBetween(-12, -12)
    return df.withColumn(out, F.max(col(value)).over(at))


def episodes(df: DataFrame, improving: Column, min_length: int, series: Sequence[str] = SERIES,
             period: str = PERIOD, aggregates: Sequence[Column] = ()) -> DataFrame:
    """Runs of consecutive rows for which ``improving`` holds, at least ``min_length`` rows long."""
    flagged = df.withColumn("_on", F.when(improving, 1).otherwise(0))
    running = by_series(series, period).rowsBetween(Window.unboundedPreceding, 0)
    islands = flagged.withColumn("_island", F.sum(1 - F.col("_on")).over(running)).where("_on = 1")
    return (
        islands.groupBy(*series, "_island")
        .agg(F.count("*").alias("episode_length"), *aggregates)
        .where(F.col("episode_length") >= min_length)
        .drop("_island")
    )


def fill(value: Column | str, method: str = "ffill", series: Sequence[str] = SERIES, period: str = PERIOD) -> Column:
    """Forward fill, backward fill, or forward then backward ("both")."""
    order = by_series(series, period)
    last = F.last(col(value), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(col(value), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return {"ffill": last, "bfill": first, "both": F.coalesce(last, first)}[method]


def interpolate(value: Column | str, series: Sequence[str] = SERIES, period: str = PERIOD,
                edges: str = "both") -> Column:
    """Linear interpolation by row position; ``edges`` fills the ends ("both", "ffill", "bfill" or "none")."""
    order = by_series(series, period)
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    v = col(value)
    position = F.row_number().over(order)
    known = F.when(v.isNotNull(), F.struct(position.alias("p"), v.alias("v")))
    before, after = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    step = (position - before["p"]) / (after["p"] - before["p"])
    inside = before["v"] + (after["v"] - before["v"]) * step
    out = F.when(v.isNotNull(), v).when(before.isNotNull() & after.isNotNull(), inside)
    if edges in ("both", "ffill"):
        out = out.when(before.isNotNull(), before["v"])
    if edges in ("both", "bfill"):
        out = out.when(after.isNotNull(), after["v"])
    return out


def leading_ramp(value: Column | str, start: float, series: Sequence[str] = SERIES, period: str = PERIOD) -> Column:
    """Replace leading nulls by a straight line from ``start`` at the first row to the first known value."""
    order = by_series(series, period)
    v = col(value)
    position = F.row_number().over(order)
    known = F.when(v.isNotNull(), F.struct(position.alias("p"), v.alias("v")))
    first = F.first(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ramp = start + (first["v"] - start) * (position - 1) / F.when(first["p"] > 1, first["p"] - 1)
    return F.when(position < first["p"], ramp).otherwise(v)


def blank_repeated_start(df: DataFrame, columns: Sequence[str], rows: int = 3, series: Sequence[str] = SERIES,
                         period: str = PERIOD) -> DataFrame:
    """Null all but the last of the first ``rows`` rows when every one of ``columns`` repeats there (a broadcast start)."""
    whole = whole_series(series)
    out = df.withColumn("_n", F.row_number().over(by_series(series, period)))
    head = F.col("_n") <= rows
    same = F.max(F.col("_n")).over(whole) >= rows
    for c in columns:
        inside = F.when(head, F.col(c))
        same = same & (F.min(inside).over(whole) == F.max(inside).over(whole))
    out = out.withColumn("_same", same)
    for c in columns:
        out = out.withColumn(c, F.when(~(F.col("_same") & (F.col("_n") < rows)), F.col(c)))
    return out.drop("_n", "_same")


def observation_index(series: Sequence[str] = SERIES, period: str = PERIOD) -> Column:
    """t = 0, 1, 2, ... within the series."""
    return F.row_number().over(by_series(series, period)) - 1


def smooth(value: str, alpha: float, series: Sequence[str] = SERIES, period: str = PERIOD) -> Callable[[DataFrame], DataFrame]:
    """Simple exponential smoothing of every series: one ordered array per series, scanned chunk by chunk."""

    def transform(df: DataFrame) -> DataFrame:
        rows = series_array(df, series, period, value)
        return rows.select(*series, F.inline(F.arrays_zip("periods", "y", smoothed(F.col("y"), F.lit(float(alpha))).alias("s"))).alias(period, value, "smoothed"))

    return transform
