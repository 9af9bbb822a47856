"""Null-safe arithmetic and small numeric helpers, all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is zero or null."""
    b = col(b)
    return col(a) / F.when(b != 0, b)


def pct_change(now: Column, before: Column) -> Column:
    return ratio(now - before, before) * 100.0


def share(part: Column | str, total: Column | str) -> Column:
    return ratio(part, total) * 100.0


def to_float(value: Column | str) -> Column:
    """Bad text and NaN become null."""
    number = F.expr(f"try_cast(`{value}` as double)") if isinstance(value, str) else value.try_cast("double")
    return F.when(~F.isnan(number), number)


def clip(value: Column | str, low: float | None, high: float | None) -> Column:
    """Clip to bounds and keep nulls null (greatest/least alone would turn a null into the bound)."""
    c = col(value)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def minmax_score(value: Column, low: Column, high: Column, invert: bool = False, flat: float | None = 50.0) -> Column:
    """0-100 position of value between low and high. A flat range scores ``flat``."""
    scaled = ratio(value - low, high - low)
    scaled = (1.0 - scaled) * 100.0 if invert else scaled * 100.0
    return F.when((high == low) & value.isNotNull(), F.lit(flat).cast("double")).otherwise(scaled)


def compare(value: Column, op: str, bound: float) -> Column:
    return {
        "<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound,
    }[op]


def as_cents(amount: Column | str) -> Column:
    """Money with two decimals as whole cents, so that sums are exact and do not depend on their order.

    ``rint`` stays in generated code; ``round`` on doubles goes through BigDecimal for every row.
    """
    return F.rint(col(amount) * 100).cast("bigint")


def rounded(value: Column | str, digits: int = 2) -> Column:
    """Half-up rounding that ignores floating-point noise beyond the sixth decimal, so 2.1749999999999998 rounds as 2.175."""
    return F.round(F.round(col(value), 6), digits)
