"""Join operators over panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from indicatrix.functions.keys import month_index

MAX_LITERAL_ROWS = 10_000


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A configuration table, marked for broadcast after its size is checked."""
    rows = list(rows)
    if len(rows) > MAX_LITERAL_ROWS:
        raise ValueError(f"{len(rows)} configuration rows; write them to a table and join it instead")
    return F.broadcast(spark.createDataFrame(rows, schema))


def periods_table(spark: SparkSession, periods: Sequence[tuple[str, int, int]]) -> DataFrame:
    return small_table(spark, periods, "period string, first_year int, last_year int")


def label_periods(df: DataFrame, periods: Sequence[tuple[str, int, int]], year: Column | str = "year") -> DataFrame:
    """Range join to labelled year ranges. Ranges may overlap or leave gaps, so a row may appear twice or not at all."""
    table = periods_table(df.sparkSession, periods)
    y = F.col(year) if isinstance(year, str) else year
    return df.join(table, y.between(F.col("first_year"), F.col("last_year"))).drop("first_year", "last_year")


def period_label(year: Column, periods: Sequence[tuple[str, int, int]]) -> Column:
    """CASE form for disjoint ranges: one label per row, null outside all of them."""
    out = None
    for label, first, last in periods:
        test = year.between(first, last)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def with_calendar(fact: DataFrame, calendar: DataFrame) -> DataFrame:
    """Fact joined to the calendar on its key. A fact outside the calendar's range stays, without calendar columns."""
    return fact.join(calendar, "date_key", "left")


def lag_join(panel: DataFrame, cause: str, effect: str, lags: Sequence[int], series: Sequence[str] = ("entity",),
             period: str = "period_start") -> DataFrame:
    """Pairs ``(cause at t - lag, effect at t)`` for every lag, aligned on the month index.

    Each cause row is repeated once per lag and met by an equi-join on (series, shifted index); no pair table is built.
    """
    index = month_index(F.col(period)).alias("_t")
    shifts = F.explode(F.array(*[F.lit(int(k)) for k in lags]))
    causes = panel.where(F.col(cause).isNotNull()).select(*series, index, F.col(cause).alias("cause"), shifts.alias("lag"))
    causes = causes.withColumn("_t", F.col("_t") + F.col("lag"))
    effects = panel.where(F.col(effect).isNotNull()).select(*series, index, F.col(effect).alias("effect"))
    return causes.join(effects, [*series, "_t"]).drop("_t")


def lag_pairs(df: DataFrame, cause: str, effect: str, lags: Sequence[int], series: Sequence[str] = ("entity",),
              period: str = "period_start") -> DataFrame:
    """The same pairs without a join: the cause ``lag`` months earlier is read from a one-month range window.

    Reads its input once, so it is the form to use when both columns come from one wide table.
    """
    at = Window.partitionBy(*series).orderBy(month_index(F.col(period)))
    pairs = F.array(*[
        F.struct(F.lit(int(k)).alias("lag"), F.max(F.col(cause)).over(at.rangeBetween(-k, -k)).alias("cause"),
                 F.col(effect).alias("effect"))
        for k in lags
    ])
    out = df.select(*series, pairs.alias("_pairs")).select(*series, F.inline("_pairs"))
    return out.where("cause is not null and effect is not null")


def as_of(changes: DataFrame, spine: DataFrame, value: str, series: Sequence[str] = ("entity",),
          change_date: str = "change_date", spine_date: str = "period_end", bucket: str = "month") -> DataFrame:
    """Step function: the last known change on or before each spine date; changes of one series have different dates.

    Changes and spine are sorted together in buckets of the calendar, so a series that holds most rows is spread over its months. A bucket's last
    value goes to the buckets after it by a window over one row for each series and bucket.
    """
    left = changes.select(*series, F.col(change_date).alias("_at"), F.col(value).alias(value), F.lit(0).alias("_spine"))
    right = spine.select(*series, F.col(spine_date).alias("_at"), F.lit(None).cast(changes.schema[value].dataType).alias(value), F.lit(1).alias("_spine"))
    keys = [*series, "_bucket"]
    rows = left.unionByName(right).withColumn("_bucket", F.trunc("_at", bucket))
    order = Window.partitionBy(*keys).orderBy("_at", "_spine").rowsBetween(Window.unboundedPreceding, 0)
    stepped = rows.withColumn(value, F.last(value, ignorenulls=True).over(order))
    ends = rows.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_end"))
    before = Window.partitionBy(*series).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    read = stepped.where("_spine = 1").join(carried, keys, "left")
    return read.select(*series, F.col("_at").alias(spine_date), F.coalesce(value, "_carried").alias(value))


def densify(panel: DataFrame, series: Sequence[str] = ("entity",), period: str = "period_start", grain: str = "month",
            start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row per series and period between ``start`` and ``end`` (default: each series' own first and last period).

    The missing periods are made from the gap to the next row, so nothing is joined or cross joined.
    """
    unit = {"day": "interval 1 day", "month": "interval 1 month", "quarter": "interval 3 month",
            "year": "interval 1 year"}[grain]
    step = F.expr(unit)
    order = Window.partitionBy(*series).orderBy(period)
    position, size = F.row_number().over(order), F.count("*").over(Window.partitionBy(*series))
    following = F.lead(period).over(order)
    before_next = (following - step).cast("date")
    last = F.coalesce(before_next, F.greatest(end, F.col(period)) if end is not None else F.col(period))
    own = F.sequence(F.col(period), last, step)
    others = [c for c in panel.columns if c not in (*series, period)]
    tail = panel.withColumn("_size", size).withColumn("_pos", position).withColumn("_all", own)
    if start is not None:
        lead_in = F.when((F.col("_pos") == 1) & (start < F.col(period)),
                         F.sequence(start, (F.col(period) - step).cast("date"), step)).otherwise(
            F.array().cast("array<date>"))
        tail = tail.withColumn("_lead", lead_in)
        tail = tail.withColumn("_all", F.concat("_lead", "_all"))
    out = tail.withColumn("_p", F.explode("_all"))
    present = F.col("_p") == F.col(period)
    return out.select(
        *series, F.col("_p").alias(period),
        *[F.when(present, F.col(c)).alias(c) for c in others], (~present).alias("is_filled"),
    )


def missing_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``expected`` without a partner: orphan keys or missing periods."""
    return expected.select(*keys).join(actual.select(*keys), list(keys), "left_anti")


def outer_merge(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Series on one key, outer merged without a chain of full outer joins.

    Each part is padded with nulls and stacked, then one aggregation per key picks the value: a single shuffle for any
    number of parts. Keys must be unique within a part.
    """
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def broadcast_down(fine: DataFrame, coarse: DataFrame, value: str, series: Sequence[str] = ("entity",),
                   period: str = "period_start") -> DataFrame:
    """Low-frequency values carried to each finer period of the same year."""
    yearly = coarse.select(*series, F.year(period).alias("_year"), F.col(value))
    return fine.withColumn("_year", F.year(period)).join(yearly, [*series, "_year"], "left").drop("_year")
