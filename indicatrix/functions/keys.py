"""Period keys and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def quarter_key(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def quarter_key_from_parts(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string"))


def period_key(date: Column, grain: str) -> Column:
    return {"month": month_key, "quarter": quarter_key, "year": lambda d: F.year(d).cast("string")}[grain](date)


def period_start(date: Column, grain: str) -> Column:
    """First day of the period as a DATE. The cast comes first, so zone-less timestamps stay zone-less."""
    return F.trunc(date.cast("date"), grain)


def parse_key(key: Column) -> Column:
    """Map ``YYYY``, ``YYYY-MM`` or ``YYYY-QN`` to the first day of that period; anything else to null."""
    year = F.try_to_number(F.regexp_extract(key, r"^(\d{4})", 1), F.lit("9999")).cast("int")
    month = F.try_to_number(F.nullif(F.regexp_extract(key, r"^\d{4}-(\d{2})$", 1), F.lit("")), F.lit("99")).cast("int")
    quarter = F.try_to_number(F.nullif(F.regexp_extract(key, r"^\d{4}-Q([1-4])$", 1), F.lit("")), F.lit("9")).cast("int")
    is_year = key.rlike(r"^\d{4}$")
    first_month = F.when(month.between(1, 12), month).when(quarter.isNotNull(), quarter * 3 - 2).when(is_year, F.lit(1))
    return F.when(first_month.isNotNull(), F.make_date(year, first_month, F.lit(1)))


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def year_quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit(" Q"), F.quarter(date).cast("string"))


def year_month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def add_periods(date: Column, n: Column, grain: str) -> Column:
    step = {"month": 1, "quarter": 3, "year": 12}[grain]
    return F.add_months(date, (n * step).cast("int"))
