from datetime import date

import pytest
from pyspark.sql import functions as F

from indicatrix.operators import joins, windows as w
from indicatrix.operators.ranking import rank_large_groups, rank_peers, score_peers


def column(df, name, entity="a"):
    return [r[name] for r in df.where(F.col("entity") == entity).orderBy("period_start").collect()]


def test_trailing_and_minimum(series):
    df = series({"a": [1, 2, 3, 4], "b": [10, 20, 30, 40]}).withColumn("m", w.trailing("value", 2)).withColumn("k", w.trailing("value", 3, min_obs=3))
    assert column(df, "m") == [1.0, 1.5, 2.5, 3.5]
    assert column(df, "k", "b") == [None, None, 20.0, 30.0]


def test_change_and_index(series):
    df = series({"a": [10, 20, 10]}).withColumn("d", w.change("value", 1)).withColumn("p", w.change("value", 1, "pct")).withColumn("i", w.cumulative_index("value"))
    assert column(df, "d") == [None, 10.0, -10.0]
    assert column(df, "p") == [None, 100.0, -50.0]
    assert column(df, "i")[1] == pytest.approx(100 * 1.1 * 1.2)


def test_fill_and_interpolate(series):
    df = series({"a": [None, 2, None, None, 8, None]}).withColumns({
        "f": w.fill("value"), "b": w.fill("value", "bfill"), "both": w.fill("value", "both"), "l": w.interpolate("value"), "inner": w.interpolate("value", edges="none"),
        "ramp": w.leading_ramp("value", 0.0)})
    assert column(df, "f") == [None, 2, 2, 2, 8, 8]
    assert column(df, "b") == [2, 2, 8, 8, 8, None]
    assert column(df, "both") == [2, 2, 2, 2, 8, 8]
    assert column(df, "l") == [2, 2, 4, 6, 8, 8]
    assert column(df, "inner") == [None, 2, 4, 6, 8, None]
    assert column(df, "ramp") == [0, 2, None, None, 8, None]


def test_calendar_windows_respect_gaps(spark):
    rows = [("a", date(2010, 1, 1), 1.0), ("a", date(2010, 2, 1), 2.0), ("a", date(2010, 4, 1), 4.0), ("a", date(2011, 1, 1), 9.0), ("a", date(2011, 3, 1), 7.0)]
    df = spark.createDataFrame(rows, "entity string, period_start date, value double")
    out = w.same_period_last_year(df.withColumn("m", w.calendar_average("value", 3)), "value", "ly")
    assert column(out, "m") == [1.0, 1.5, 3.0, 9.0, 8.0]
    assert column(out, "ly") == [None, None, None, 1.0, None]


def test_episodes(series):
    df = series({"a": [5, 4, 3, 2, 9, 8, 9, 8, 7, 6, 5]}).withColumn("d", w.change("value", 1)).where("d is not null")
    out = w.episodes(df, F.col("d") < 0, 3, aggregates=[F.min("period_start").alias("start"), F.sum("d").alias("total")])
    assert sorted((r["episode_length"], r["total"]) for r in out.collect()) == [(3, -3.0), (4, -4.0)]


def test_repeated_start(series):
    df = w.blank_repeated_start(series({"a": [5, 5, 5, 6], "b": [5, 5, 6, 6]}), ["value"])
    assert column(df, "value") == [None, None, 5, 6]
    assert column(df, "value", "b") == [5, 5, 6, 6]


def test_smoothing(series):
    df = w.smooth("value", 0.5)(series({"a": [2, 4, 8]}))
    assert column(df, "smoothed") == [2.0, 3.0, 5.5]


def test_densify(spark):
    rows = [("a", date(2010, 1, 1), 1.0), ("a", date(2010, 4, 1), 4.0), ("b", date(2010, 2, 1), 7.0)]
    df = spark.createDataFrame(rows, "entity string, period_start date, value double")
    own = joins.densify(df)
    assert column(own, "value") == [1.0, None, None, 4.0] and column(own, "is_filled") == [False, True, True, False]
    assert column(own, "value", "b") == [7.0]
    full = joins.densify(df, start=F.lit(date(2009, 12, 1)), end=F.lit(date(2010, 5, 1)))
    assert column(full, "value", "b") == [None, None, 7.0, None, None, None]
    assert column(full, "value") == [None, 1.0, None, None, 4.0, None]


def test_as_of(spark):
    changes = spark.createDataFrame([("a", date(2010, 1, 10), 1.0), ("a", date(2010, 3, 31), 2.0)], "entity string, change_date date, rate double")
    spine = spark.createDataFrame([("a", date(2009, 12, 31)), ("a", date(2010, 1, 31)), ("a", date(2010, 2, 28)), ("a", date(2010, 3, 31))], "entity string, period_end date")
    got = {r["period_end"]: r["rate"] for r in joins.as_of(changes, spine, "rate").collect()}
    assert list(got[d] for d in sorted(got)) == [None, 1.0, 1.0, 2.0]


def test_lag_pairs_equal_lag_join(series):
    df = series({"a": [1, 2, None, 4, 5], "b": [3, 1, 4, 1, 5]}).withColumn("effect", F.col("value") * 2)
    key = lambda out: sorted((r["entity"], r["lag"], r["cause"], r["effect"]) for r in out.collect())
    assert key(joins.lag_pairs(df, "value", "effect", [0, 1, 2])) == key(joins.lag_join(df, "value", "effect", [0, 1, 2]))


def test_overlapping_labels(spark):
    df = spark.createDataFrame([(2010,), (2011,), (2030,)], "year int")
    out = joins.label_periods(df, [("p", 2010, 2011), ("q", 2011, 2014)])
    assert sorted((r["year"], r["period"]) for r in out.collect()) == [(2010, "p"), (2011, "p"), (2011, "q")]


def test_configuration_tables_are_bounded(spark):
    with pytest.raises(ValueError):
        joins.small_table(spark, [(i,) for i in range(joins.MAX_LITERAL_ROWS + 1)], "x int")


def test_outer_merge(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, b double")
    assert sorted(tuple(r) for r in joins.outer_merge([a, b], ["k"]).collect()) == [(1, 1.0, None), (2, 2.0, 5.0), (3, None, 6.0)]


def test_large_group_ranks_match_a_window_rank(spark):
    """One group holds most rows, many values tie."""
    rows = spark.range(20000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("g"), F.col("id").alias("entity"),
                                     (F.pmod(F.xxhash64("id"), F.lit(3000)) / 7.0).alias("value"))
    from pyspark.sql import Window

    for lower in (True, False):
        order = F.col("value") if lower else F.desc("value")
        want = rows.withColumn("want", F.rank().over(Window.partitionBy("g").orderBy(order))).select("entity", "want")
        got = rank_large_groups(rows, ["g"], lower_is_better=lower, buckets=16)
        assert got.count() == 20000
        assert got.join(want, "entity").where("rank <> want").count() == 0


def test_rank_and_score_peers(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "entity string, value double").withColumn("g", F.lit(1))
    assert {r["entity"]: r["rank"] for r in rank_peers(df, ["g"], lower_is_better=True).collect()} == {"a": 1, "c": 2, "b": 3}
    assert {r["entity"]: r["score"] for r in score_peers(df, ["g"], lower_is_better=True).collect()} == {"a": 100.0, "c": 50.0, "b": 0.0}
