"""Calendar and source dimensions, generated by Spark."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from indicatrix.functions.keys import month_key, quarter_key
from indicatrix.operators.joins import small_table
from indicatrix.registry import SOURCES


def calendar(spark: SparkSession, start: str | date | None = "2010-01-01", end: str | date | None = "2025-12-31") -> DataFrame:
    """Monthly and quarterly keys between two dates in one table. Months carry their first day, quarters their last."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"),
                             F.expr("interval 1 month"))).alias("d"))
    months = days.select(
        month_key(F.col("d")).alias("date_key"), F.col("d").alias("full_date"), F.year("d").alias("year"),
        F.quarter("d").alias("quarter"), F.month("d").alias("month"), F.date_format("d", "MMMM").alias("month_name"),
        (F.month("d") % 3 == 0).alias("is_quarter_end"))
    quarters = days.where((F.month("d") % 3 == 0)).select(
        quarter_key(F.col("d")).alias("date_key"), F.last_day("d").alias("full_date"), F.year("d").alias("year"),
        F.quarter("d").alias("quarter"), F.lit(None).cast("int").alias("month"),
        F.lit(None).cast("string").alias("month_name"), F.lit(True).alias("is_quarter_end"))
    return months.unionByName(quarters)


def calendar_of(facts: DataFrame, day: str = "period_start") -> DataFrame:
    """The calendar from the first month of the facts to the end of their last quarter; empty where they have no day."""
    day = F.col(day).cast("date")
    span = facts.agg(F.min(day).alias("a"), F.max(F.last_day(F.add_months(F.trunc(day, "quarter"), 2))).alias("b")).first()
    return calendar(facts.sparkSession, span["a"], span["b"])


def sources(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, name, url, f"{name} statistics") for i, (name, url) in enumerate(SOURCES)]
    return small_table(spark, rows, "source_key int, source_name string, source_url string, description string")
