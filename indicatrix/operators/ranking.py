"""Ranks and scores among peers of one period.

A period's peer group has one row per entity. With few entities a plain window is right; with millions it would put the
whole group into one task, so ``rank_peers`` has a second form that never holds a group in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from indicatrix.functions.numeric import minmax_score
from indicatrix.session import ensure_checkpoint_dir


def signed(value: Column, lower_is_better: Column | bool) -> Column:
    """Key that sorts best first when ascending."""
    flag = F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better
    return F.when(flag, value).otherwise(-value)


def rank_peers(df: DataFrame, group: Sequence[str], value: str = "value", lower_is_better: Column | bool = False,
               out: str = "rank", tie_break: Sequence[str] = ("entity",)) -> DataFrame:
    """1 = best within the group; ties are broken by entity. For peer groups of bounded size."""
    best_first = Window.partitionBy(*group).orderBy("_signed", *tie_break)
    return df.withColumn("_signed", signed(F.col(value), lower_is_better)).withColumn(
        out, F.row_number().over(best_first)).drop("_signed")


def rank_large_groups(df: DataFrame, group: Sequence[str], value: str = "value", lower_is_better: bool = False,
                      out: str = "rank", buckets: int = 200) -> DataFrame:
    """Competition rank (ties share a rank) within groups of any size.

    1. Values are counted per group (map-side combine), so ties collapse.
    2. Approximate quantiles cut each group into ``buckets`` value ranges; the cut points are written to the checkpoint
       folder, so that every later step sees the same ones.
    3. Rank = rows in better buckets (a window over at most ``buckets`` rows per group) + rows with a better value in
       the same bucket (a window over one bucket) + 1.
    The cut points only balance the work; the ranks are exact for any cuts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    best_first = df.where(F.col(value).isNotNull()).withColumn("_v", signed(F.col(value), lower_is_better))
    counts = best_first.groupBy(*group, "_v").agg(F.count("*").alias("_n"))
    levels = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = best_first.groupBy(*group).agg(F.percentile_approx("_v", levels, F.lit(10_000)).alias("_cuts")).checkpoint()
    placed = counts.join(cuts, list(group)).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    totals = placed.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_in_bucket"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_bucket", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        offsets, [*group, "_bucket"]).select(*group, "_v", (F.col("_offset") + F.col("_inside") + 1).alias(out))
    return best_first.join(ranked, [*group, "_v"]).drop("_v")


def number_large_groups(df: DataFrame, group: Sequence[str], value: str = "value", lower_is_better: Column | bool = False,
                        out: str = "rank", tie_break: Sequence[str] = ("entity",), parts: int | None = None) -> DataFrame:
    """1, 2, ... from the best within groups of any size, ties broken by ``tie_break``: what ``rank_peers`` gives, without a group in one task.

    1. Rows are dealt into ranges of the whole key (group, value, tie_break), so that equal values of many entities are split too, and written with the number of
       their range to the checkpoint folder: every later step sees the same ranges.
    2. Rows are counted per group and range; a window over at most one row for each range gives the rows in the ranges before.
    3. A window over one group and range numbers the rows inside it.
    A null value comes last. Rows equal in all of the key are numbered in any order.
    """
    ensure_checkpoint_dir(df.sparkSession)
    key = signed(F.col(value), lower_is_better)
    order = [F.asc_nulls_last("_signed"), *[F.asc(c) for c in tie_break]]
    width = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("_signed", key).repartitionByRange(width, *[F.asc(c) for c in group], *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    numbered = ranged.withColumn("_inside", inside).join(offsets, [*group, "_range"])
    return numbered.withColumn(out, (F.col("_offset") + F.col("_inside"))).drop("_signed", "_range", "_inside", "_offset")


def score_peers(df: DataFrame, group: Sequence[str], value: str = "value", lower_is_better: Column | bool = False,
                out: str = "score") -> DataFrame:
    """0-100 position between the group's minimum and maximum. The bounds come from an aggregation with map-side combine
    and are joined back, so group size does not matter."""
    bounds = df.groupBy(*group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    flag = F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better
    scored = df.join(bounds, list(group)).withColumn(
        out, F.when(flag, minmax_score(F.col(value), F.col("_low"), F.col("_high"), True)).otherwise(
            minmax_score(F.col(value), F.col("_low"), F.col("_high"))))
    return scored.drop("_low", "_high")
