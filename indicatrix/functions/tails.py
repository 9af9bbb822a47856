"""Tail probabilities and quantiles of the t and F distributions.

Spark has neither. The functions below evaluate the regularised incomplete beta function on already aggregated rows
(one row per series and test), vectorised over an Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _lgamma(values: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(values)]).reshape(np.shape(values))


def regularised_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b) by its continued fraction, using the symmetry x -> 1 - x where that converges faster."""
    x, a, b = (np.asarray(v, dtype=float) for v in (x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 1e-300, 1.0)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1.0 - (p + q) * z / (p + 1)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for numerator in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                          -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    front = np.exp(p * np.log(z) + q * np.log1p(-np.minimum(z, 1 - 1e-16))
                   + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    value = np.clip(front * h, 0.0, 1.0)
    value = np.where(swap, 1.0 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
        return regularised_beta(x, df / 2, np.full_like(df, 0.5))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))
        return regularised_beta(x, d2 / 2, d1 / 2)


def t_coverage(t: Column, df: Column) -> Column:
    """P(|T| <= t) for whole degrees of freedom, as an expression: the finite series in cos^2 of the angle whose tangent is t / sqrt(df)."""
    square = df / (df + t * t)
    odd = df % 2 == 1
    terms = F.floor(F.when(odd, (df - 1) / 2).otherwise(df / 2)).cast("int")
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term"))

    def step(acc: Column, k: Column) -> Column:
        grows = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct((acc["total"] + acc["term"]).alias("total"), (acc["term"] * grows * square).alias("term"))

    series = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["total"])
    sine = t / F.sqrt(df + t * t)
    return F.when(odd, (F.atan(t / F.sqrt(df)) + sine * F.sqrt(square) * series) * (2 / math.pi)).otherwise(sine * series)


def t_two_sided_quantile(level: float, df: Column) -> Column:
    """The value that |T| stays within with this probability, for whole degrees of freedom from 1 on: bisection of ``t_coverage``, inside Catalyst."""
    whole = F.when(df >= 1, df.cast("double"))
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1e4).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        below = t_coverage(middle, whole) < level
        return F.struct(F.when(below, middle).otherwise(acc["low"]).alias("low"), F.when(below, acc["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda acc: (acc["low"] + acc["high"]) / 2)
    return F.when(whole.isNotNull(), found)


def t_quantile(level: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided critical value: P(|T| > value) = 1 - level, by bisection."""
    level, df = np.asarray(level, dtype=float), np.asarray(df, dtype=float)
    low, high = np.zeros_like(df), np.full_like(df, 1e4)
    for _ in range(80):
        middle = (low + high) / 2
        above = t_two_sided(middle, df) > 1 - level
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _where_known(fn, *columns: pd.Series) -> pd.Series:
    known = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
    out = np.full(len(columns[0]), np.nan)
    if known.any():
        out[known] = fn(*[c.to_numpy(dtype=float)[known] for c in columns])
    return pd.Series(out).astype(object).where(known, None).astype("Float64")


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _where_known(t_two_sided, t, df)


@pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _where_known(f_upper, f, d1, d2)
