"""Least squares with several regressors inside Catalyst: a Gram matrix is one set of sums, solved by sweeping it as a nested array.

The matrix has one row and column for each regressor and the target last. Sums come from a grouped aggregation or, with ``over``, from a running window, which gives
the fit up to every row at once. Nothing is refitted, no Python runs, and the arrays have the size of the model, whatever the length of a series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

TOLERANCE = 1e-10


def standardized(df: DataFrame, value: str, series: Sequence[str], into: str = "z") -> DataFrame:
    """(value - mean) / sd of the series, and both as ``_mean`` and ``_sd`` (1 for a constant series): sums of squares keep their digits."""
    whole = Window.partitionBy(*series)
    sd = F.stddev_samp(value).over(whole)
    out = df.withColumn("_mean", F.avg(value).over(whole)).withColumn("_sd", F.when(sd > 0, sd).otherwise(1.0))
    return out.withColumn(into, (F.col(value) - F.col("_mean")) / F.col("_sd"))


def gram(columns: Sequence[Column], sample: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Sums of products of all pairs of columns over the rows of the sample, as an array of arrays; a null counts as 0."""
    def total(i: int, j: int) -> Column:
        return F.coalesce(over(F.sum(F.when(sample, columns[min(i, j)] * columns[max(i, j)]))), F.lit(0.0))

    return F.array(*[F.array(*[total(i, j) for j in range(len(columns))]) for i in range(len(columns))])


def sweep(matrix: Column, regressors: int) -> Column:
    """The matrix swept on its first ``regressors`` columns: struct of a (inverse, coefficients in the last column, residual sum of squares in the corner) and used.

    A regressor that those before it explain (its rest is within TOLERANCE of its own square) is not used; its coefficient counts as 0.
    """
    def step(acc: Column, k: Column) -> Column:
        a, pivot_row = acc["a"], acc["a"][k]
        d = pivot_row[k]
        good = d > acc["size"][k] * TOLERANCE
        swept = F.transform(a, lambda row, i: F.transform(row, lambda x, j: F.when((i == k) & (j == k), 1 / d).when(i == k, x / d).when(j == k, -x / d)
                                                          .otherwise(x - row[k] * pivot_row[j] / d)))
        return F.struct(F.when(good, swept).otherwise(a).alias("a"), acc["size"].alias("size"), F.concat(acc["used"], F.array(good)).alias("used"))

    start = F.struct(matrix.alias("a"), F.transform(matrix, lambda row, i: row[i]).alias("size"), F.array().cast("array<boolean>").alias("used"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(regressors)]), start, step)


def coefficient(swept: Column, k: int, target: int) -> Column:
    return F.when(swept["used"][k], swept["a"][k][target]).otherwise(0.0)


def residual_square(swept: Column, target: int) -> Column:
    return F.greatest(swept["a"][target][target], F.lit(0.0))
