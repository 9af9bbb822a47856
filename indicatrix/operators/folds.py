"""Recurrences over one array per series: smoothing as a scan of chunks, seasonal smoothing and autoregressive paths as folds with a state of fixed size.

A series has one row for each period, so its array is bounded by the calendar; no fold copies more than its own state or one chunk at a step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Steps of a recurrence that are appended one by one; longer series are scanned chunk by chunk.
CHUNK = 128


def series_array(panel: DataFrame, series: Sequence[str], period: str = "period_start", value: str = "value") -> DataFrame:
    """One row for each series: ``periods`` and ``y``, the known values in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("v"))))
    rows = panel.where(F.col(value).isNotNull()).groupBy(*series).agg(pairs.alias("_o"))
    return rows.select(*series, F.col("_o.p").alias("periods"), F.col("_o.v").alias("y"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body uses it in a lambda of its own."""
    return F.transform(F.array(value), body)[0]


def recurrence(b: Column, a: Column, start: Column, chunk: int = CHUNK) -> Column:
    """s_i = a s_(i-1) + b_i for every element of the array b, from s_(-1) = start.

    Steps compose: two of them are again one, x -> a x + b. Every chunk is composed to one such pair, the pairs carry the state from chunk to chunk, and the
    chunks are then filled from their own carried state. Work and copies are in proportion to the array, whatever its length, but for the list of chunks.
    """
    def cut(values: Column) -> Column:
        last = F.greatest(F.floor((F.size(values) - 1) / chunk), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * chunk + 1, chunk))

    def composed(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda acc, x: F.struct((acc["a"] * a).alias("a"), (acc["b"] * a + x).alias("b")))

    def carried(whole: Column) -> Column:
        return F.aggregate(F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))), F.array(start), lambda acc, w: F.concat(acc, F.array(w["a"] * F.element_at(acc, -1) + w["b"])))

    def filled(chunks: Column) -> Column:
        states = bound(F.transform(chunks, composed), carried)
        return F.flatten(F.zip_with(chunks, states, lambda part, state: F.slice(F.aggregate(
            part, F.array(state), lambda acc, x: F.concat(acc, F.array(a * F.element_at(acc, -1) + x))), 2, chunk)))

    return bound(bound(b, cut), filled)


def smoothed(y: Column, alpha: Column) -> Column:
    """Simple exponential smoothing of an array, from its first value on."""
    return recurrence(F.transform(y, lambda v: alpha * v), 1 - alpha, F.coalesce(F.get(y, F.lit(0)), F.lit(0.0)))


# ---- additive level, trend and season -----------------------------------------------------------------------------

#: The grid of weights for level, trend and season.
LEVEL_WEIGHTS, TREND_WEIGHTS, SEASON_WEIGHTS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.0, 0.05, 0.2), (0.05, 0.2, 0.5)


def seasonal_fit(y: Column, cycle: int) -> Column:
    """The weights of the grid with the smallest squared error (of equal ones the first), as a struct: sse, the state at the end, and sr, the sum of errors.

    The state of each fold is a level, a trend and a ring of ``cycle`` seasonal terms, of which the first belongs to the next value. Null below two cycles.
    """
    grid = [(a, b, g) for a in LEVEL_WEIGHTS for b in TREND_WEIGHTS for g in SEASON_WEIGHTS]
    weights = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for i, (a, b, g) in enumerate(grid)])

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / cycle

    first, second = mean(F.slice(y, 1, cycle)), mean(F.slice(y, cycle + 1, cycle))
    start = F.struct(first.alias("level"), ((second - first) / cycle).alias("trend"), F.transform(F.slice(y, 1, cycle), lambda v: v - first).alias("ring"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("sr"))

    def run(w: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            season = s["ring"][0]
            error = v - (s["level"] + s["trend"] + season)
            level = w["alpha"] * (v - season) + (1 - w["alpha"]) * (s["level"] + s["trend"])
            trend = w["beta"] * (level - s["level"]) + (1 - w["beta"]) * s["trend"]
            ring = F.concat(F.slice(s["ring"], 2, cycle - 1), F.array(w["gamma"] * (v - level) + (1 - w["gamma"]) * season))
            return F.struct(level.alias("level"), trend.alias("trend"), ring.alias("ring"), (s["sse"] + error * error).alias("sse"), (s["sr"] + error).alias("sr"))

        return F.aggregate(y, start, step, lambda s: F.struct(s["sse"].alias("sse"), w["i"].alias("i"), s["level"].alias("level"), s["trend"].alias("trend"), s["ring"].alias("ring"), s["sr"].alias("sr")))

    return F.when(F.size(y) >= 2 * cycle, F.array_min(F.transform(weights, run)))


def seasonal_path(fit: Column, cycle: int, horizon: int) -> Column:
    """The next ``horizon`` values from the state of a fit."""
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: fit["level"] + h * fit["trend"] + fit["ring"][((h - 1) % cycle).cast("int")])


def spread(sse: Column, sr: Column, n: Column) -> Column:
    """Sample standard deviation of errors from their sum of squares and sum."""
    return F.sqrt(F.greatest(sse - sr * sr / n, F.lit(0.0)) / F.when(n > 1, n - 1))


def autoregressive_path(beta: Sequence[Column], last: Sequence[Column], level: Column, differenced: Column, horizon: int) -> Column:
    """Steps b0 + b1 w1 + b2 w2 + ... from the last values (newest first); where ``differenced`` they are added up from the level."""
    start = F.struct(F.array(*last).alias("w"), level.alias("level"), F.array().cast("array<double>").alias("path"))

    def step(acc: Column, h: Column) -> Column:
        value = beta[0]
        for j, b in enumerate(beta[1:]):
            value = value + b * acc["w"][j]
        out = F.when(differenced, acc["level"] + value).otherwise(value)
        return F.struct(F.concat(F.array(value), F.slice(acc["w"], 1, len(last) - 1)).alias("w"), out.alias("level"), F.concat(acc["path"], F.array(out)).alias("path"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["path"])
