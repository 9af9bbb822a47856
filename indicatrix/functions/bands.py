"""First-match banding: one generic operator for every threshold list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from indicatrix.functions.numeric import col, compare
from indicatrix.registry import BANDS

Rows = list[tuple[str, float, str]]


def band(value: Column | str, bands: str | tuple[Rows, str | None], null_label: str | None = "__fallback__") -> Column:
    """Label ``value`` with the first band it satisfies.

    A null satisfies no comparison and takes the fallback label, as a CASE would; pass ``null_label=None`` to keep it null.
    """
    rows, fallback = BANDS[bands] if isinstance(bands, str) else bands
    c = col(value)
    out = None
    if null_label != "__fallback__":
        out = F.when(c.isNull(), F.lit(null_label))
    for op, bound, label in rows:
        test = compare(c, op, bound)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(fallback))


def apply_bands(df: DataFrame, column: str, bands: str | tuple[Rows, str | None], out: str) -> DataFrame:
    return df.withColumn(out, band(column, bands))
