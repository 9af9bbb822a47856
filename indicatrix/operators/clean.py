"""Cleaning: rename, key, clip, pillar rules, provisional flag, rounding and projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from indicatrix.functions.keys import parse_key, period_key, quarter_key_from_parts
from indicatrix.functions.numeric import clip, ratio, rounded
from indicatrix.operators.joins import densify
from indicatrix.operators.windows import blank_repeated_start, change, fill, interpolate, trailing, whole_series
from indicatrix.registry import PILLARS, PROVISIONAL_LAG_MONTHS, Pillar

Rule = tuple[str, float | None, float | None]


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the raw columns that are present; a legacy name is skipped when its target already exists."""
    taken, chosen = set(df.columns), {}
    for old, new in mapping.items():
        if old in taken and new not in taken and new not in chosen.values():
            chosen[old] = new
    return df.withColumnsRenamed(chosen)


def add_key(df: DataFrame, grain: str) -> DataFrame:
    """``date_key`` and ``period_start`` from year and quarter columns where present, else from ``date``."""
    if grain == "quarter" and {"year", "quarter"} <= set(df.columns):
        key = quarter_key_from_parts(F.col("year"), F.col("quarter"))
    elif "date" in df.columns:
        key = period_key(F.to_date("date"), grain)
    else:
        raise ValueError("cannot derive a period key: no date column and no year and quarter columns")
    return df.withColumn("date_key", key).withColumn("period_start", parse_key(F.col("date_key")))


def clip_rules(pillar: Pillar) -> list[Rule]:
    return [(i.name, i.clip_low, i.clip_high) for i in pillar.indicators
            if i.clip_low is not None or i.clip_high is not None]


def clip_columns(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rules = [rule for rule in rules if rule[0] in df.columns]
    return df.withColumns({c: clip(c, low, high) for c, low, high in rules})


def clip_report(df: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ("entity",)) -> DataFrame:
    """How many rows of each column fall outside its bounds: one pass for all rules."""
    counts = []
    for c, low, high in rules:
        outside = F.lit(False)
        if low is not None:
            outside = outside | (F.col(c) < low)
        if high is not None:
            outside = outside | (F.col(c) > high)
        counts.append(F.count_if(outside).alias(c))
    wide = df.groupBy(*by).agg(*counts)
    return wide.unpivot(list(by), [c for c, _, _ in rules], "indicator", "n_clipped")


def round_numeric(df: DataFrame, digits: int, skip: Sequence[str] = ()) -> DataFrame:
    """Round every floating column of the schema."""
    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType)
             and f.dataType.typeName() in ("double", "float") and f.name not in skip]
    return df.withColumns({c: rounded(c, digits) for c in names})


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ordered projection that tolerates absent columns."""
    return df.select(*[c for c in columns if c in df.columns])


def flag_provisional(df: DataFrame, grain: str, fetched_at: Column | None = None,
                     fallback: date = date(2025, 7, 1)) -> DataFrame:
    """Flag periods later than the last confirmed one: the fetch date less the publication lag of the grain.

    Without a fetch date everything from ``fallback`` on is provisional.
    """
    from_fallback = F.col("period_start") >= F.lit(fallback)
    if fetched_at is None:
        return df.withColumn("is_provisional", from_fallback)
    confirmed = F.trunc(F.add_months(F.to_date(fetched_at), -PROVISIONAL_LAG_MONTHS[grain]), grain)
    late = F.col("period_start") > confirmed
    return df.withColumn("is_provisional", F.when(confirmed.isNull(), from_fallback).otherwise(late))


def override(df: DataFrame, column: str, value: float, start: Column, end: Column,
             only_null: bool = True) -> DataFrame:
    """Set a known value inside a date window, by default only where it is missing."""
    test = F.col("period_start").between(start, end)
    if only_null:
        test = test & F.col(column).isNull()
    return df.withColumn(column, F.when(test, F.lit(float(value))).otherwise(F.col(column)))


def enforce_parts(df: DataFrame, parts: Sequence[str], total: str, digits: int = 2) -> DataFrame:
    """Scale parts down in proportion where they add up to more than the total."""
    both = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    over = both > F.col(total)
    scale = ratio(F.col(total), both)
    return df.withColumns({p: F.when(over, rounded(F.col(p) * scale, digits)).otherwise(F.col(p)) for p in parts})


def mark_estimated_copy(df: DataFrame, original: str, copy: str, flag: str, offset: float = -0.15,
                        share: float = 0.95, tolerance: float = 0.01) -> DataFrame:
    """Flag a series that only repeats another, and shift it by a fixed offset so it is not taken for a measurement."""
    whole = whole_series()
    near = F.when(F.abs(F.col(original) - F.col(copy)) < tolerance, 1).otherwise(0)
    repeated = F.avg(near).over(whole) > share
    shifted = F.when(repeated, rounded(F.col(original) + offset, 2)).otherwise(F.col(copy))
    return df.withColumn(flag, repeated).withColumn(copy, shifted)


# ---- rules of single pillars --------------------------------------------------------------------------------------

Hook = Callable[[DataFrame, Column, Column], DataFrame]


def _grid(df: DataFrame, grain: str, start: Column, end: Column, columns: Sequence[str]) -> DataFrame:
    dense = densify(df, grain=grain, start=start, end=end)
    filled = dense.withColumns({c: interpolate(c) for c in columns})
    return filled.withColumn("date_key", period_key(F.col("period_start"), grain)).drop("is_filled")


def gdp_rules(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Growth always follows from the real series."""
    return df.withColumns({
        "gdp_growth_qoq": change("real_gdp", 1, "pct"), "gdp_growth_yoy": change("real_gdp", 4, "pct"),
    })


def inflation_rules(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return mark_estimated_copy(df, "hicp", "cpi_estimated", "cpi_is_estimated")


def interest_rate_rules(df: DataFrame, start: Column, end: Column, known_rate: float = 1.0,
                        known_until: Column | None = None) -> DataFrame:
    """Policy rates are steps: a known early value, then the nearest known one."""
    if known_until is None:
        known_until = F.lit(date(2011, 3, 1))
    column = "ecb_main_refinancing_rate"
    known = override(df, column, known_rate, start, known_until)
    return known.withColumn(column, fill(column, "both"))


def credit_rules(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Undo a broadcast start, fill missing months on a line, keep parts within the total."""
    columns = [c for c in PILLARS["credit"].columns if c in df.columns]
    blanked = blank_repeated_start(df, columns)
    return enforce_parts(_grid(blanked, "month", start, end, columns), ("credit_nfc", "credit_households"), "total_credit")


def public_debt_rules(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Plausible balance, a full quarterly grid, and the balance averaged over four quarters."""
    external = "external_debt_share_estimated"
    if external not in df.columns:
        df = df.withColumn(external, F.lit(None).cast("double"))
    df = df.withColumn("budget_deficit", clip("budget_deficit", -25, 10))
    df = df.withColumn(external, interpolate(external, edges="ffill"))
    columns = [c for c in PILLARS["public_debt"].columns if c in df.columns and c != "budget_deficit_annual"]
    full = _grid(df, "quarter", start, end, columns)
    return full.withColumn("budget_deficit_annual", trailing("budget_deficit", 4, min_obs=4))


HOOKS: dict[str, Hook] = {
    "gdp": gdp_rules, "inflation": inflation_rules, "interest_rates": interest_rate_rules, "credit": credit_rules,
    "public_debt": public_debt_rules,
}


def transform_pillar(raw: DataFrame, pillar: str, fetched_at: Column | None = None, start: Column | None = None,
                     end: Column | None = None, hook: Hook | None = None) -> DataFrame:
    """Raw table to fact: rename, key, clip, pillar rules, provisional flag, rounding, projection.

    ``hook`` replaces the pillar's own rules by any ``(df, start, end) -> df``.
    """
    spec = PILLARS[pillar]
    start = F.lit(date(2010, 1, 1)) if start is None else start
    end = F.lit(date(2025, 10 if spec.grain == "quarter" else 12, 1)) if end is None else end
    if "entity" not in raw.columns:
        raw = raw.withColumn("entity", F.lit("PT"))
    keyed = add_key(rename(raw, spec.rename), spec.grain)
    kept = keyed.drop("date", *(c for c in ("year", "quarter", "month") if c in keyed.columns))
    cleaned = clip_columns(kept, clip_rules(spec))
    rules = hook or HOOKS.get(pillar)
    if rules is not None:
        cleaned = rules(cleaned, start, end)
    flagged = flag_provisional(cleaned, spec.grain, fetched_at)
    final = round_numeric(flagged, spec.decimals)
    return project(final, ["entity", "period_start", "date_key", *spec.columns, *spec.extra_columns, "is_provisional"])


def transform_all(raw: dict[str, DataFrame], **options) -> dict[str, DataFrame]:
    return {key: transform_pillar(df, key, **options) for key, df in raw.items() if key in PILLARS}


def timeseries(fact: DataFrame, first_year: int, last_year: int, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Year range, column subset and row limit of one fact, in key order: the parameterised fetch of a report page."""
    start, stop = F.lit(date(first_year, 1, 1)), F.lit(date(last_year, 12, 31))
    kept = fact.where(F.col("period_start").between(start, stop)).select("entity", "date_key", *columns)
    ordered = kept.orderBy("date_key", "entity")
    return ordered if limit is None else ordered.limit(limit)
