import numpy as np
import pytest
from pyspark.sql import functions as F

from indicatrix.operators import statistics as st
from indicatrix.operators import summaries as sm


def correlate(spark, xs, ys):
    df = spark.createDataFrame([("a", None if x is None else float(x), None if y is None else float(y)) for x, y in zip(xs, ys)], "entity string, x double, y double")
    return st.with_correlation(df.groupBy("entity").agg(st.moments("y", "x").alias("m"))).first()


def test_pearson_known_answers(spark):
    up = correlate(spark, [1, 2, 3, 4, 5], [2, 4, 6, 8, 10])
    assert (up["r"], up["n"], up["strength"]) == (1.0, 5, "strong")
    assert correlate(spark, [1, 2, 3, 4, 5], [10, 8, 6, 4, 2])["r"] == -1.0
    gaps = correlate(spark, [1, None, 3, None, 5, 6], [2, 3, None, 5, 9, 13])
    assert gaps["n"] == 3
    short = correlate(spark, [1, 2], [3, 4])
    assert short["r"] is None and short["n"] == 2 and short["strength"] == "insufficient data"
    flat = correlate(spark, [1, 1, 1, 1], [1, 2, 3, 4])
    assert flat["r"] is None and flat["p_value"] is None


def test_trend(series):
    rng = np.random.default_rng(1)
    out = {r["entity"]: r for r in st.trend_test(series({"up": [3 + 0.5 * i + rng.normal(0, 0.1) for i in range(20)], "noise": list(rng.normal(0, 1, 20)), "short": [1, 2]})).collect()}
    assert out["up"]["slope"] == pytest.approx(0.5, abs=0.02) and out["up"]["significant"]
    assert out["noise"]["p_value"] > 0.01
    assert out["short"]["slope"] is None and out["short"]["p_value"] is None


def brute_adf(y):
    y = np.asarray(y, float)
    d = np.diff(y)
    p = min(4, len(d) // 4)
    rows, target = [], []
    for t in range(p, len(d)):
        rows.append([1.0, y[t]] + [d[t - j] for j in range(1, p + 1)])
        target.append(d[t])
    x, target = np.array(rows), np.array(target)
    beta = np.linalg.solve(x.T @ x, x.T @ target)
    s2 = ((target - x @ beta) ** 2).sum() / (len(target) - x.shape[1])
    return beta[1] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]), len(target)


def test_unit_root(series):
    rng = np.random.default_rng(7)
    noise, walk = rng.normal(0, 1, 120), np.cumsum(rng.normal(0, 1, 120))
    out = {r["entity"]: r for r in st.unit_root(series({"noise": list(noise), "walk": list(walk), "flat": [1.0] * 30, "short": [1, 2, 3]})).collect()}
    for name, y in (("noise", noise), ("walk", walk)):
        stat, n = brute_adf(y)
        assert out[name]["adf_statistic"] == pytest.approx(stat, abs=1e-3) and out[name]["n_obs"] == n
    assert out["noise"]["is_stationary"] and not out["walk"]["is_stationary"]
    assert out["flat"]["adf_statistic"] is None and out["short"]["p_value"] is None


def test_breaks_and_periods(series):
    rng = np.random.default_rng(3)
    values = {"broken": list(rng.normal(0, 0.1, 60)) + list(rng.normal(5, 0.1, 60)), "steady": list(rng.normal(0, 0.1, 120))}
    panel = series(values).withColumn("year", F.year("period_start"))
    annual = panel.groupBy("entity", "indicator", "year").agg(F.avg("value").alias("value"))
    found = {(r["entity"], r["break_label"]): r for r in st.break_test(annual, [("mid", 2015), ("edge", 2011)]).collect()}
    assert found[("broken", "mid")]["significant"] and not found[("steady", "mid")]["significant"]
    assert found[("broken", "edge")]["f_statistic"] is None
    stats = st.period_stats(panel, [("early", 2010, 2014), ("late", 2015, 2019), ("never", 2050, 2060)])
    f = {r["entity"]: r for r in st.anova(stats).collect()}
    assert f["broken"]["significant"] and f["broken"]["n_periods"] == 2
    pairs = {r["entity"]: r for r in st.period_pairs(stats, ["early", "late", "never"]).collect()}
    assert len(pairs) == 2 and pairs["broken"]["significant"] and pairs["broken"]["cohens_d"] < -10


def test_lead_lag_recovers_the_lag(spark, series):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 100)
    y = np.concatenate([np.zeros(3), x[:-3]]) + rng.normal(0, 0.1, 100)
    panel = series({"a": list(x)}).withColumnRenamed("value", "x").join(series({"a": list(y)}).withColumnRenamed("value", "y"), ["entity", "indicator", "period_start"])
    best = st.lead_lag(panel, "x", "y", 6).where("is_best").collect()
    assert [r["lag"] for r in best] == [3]


def test_decomposition_parts_sum(series):
    y = [10 + 0.1 * i + [3, -1, -2, 0][i % 4] for i in range(40)]
    rows = st.decompose(series({"a": y, "short": [1.0] * 8}), 4).orderBy("period_start").collect()
    assert {r["entity"] for r in rows} == {"a"}
    assert all(r["observed"] == pytest.approx(r["trend"] + r["seasonal"] + r["residual"]) for r in rows)
    assert [round(r["seasonal"], 6) for r in rows[8:12]] == [3.0, -1.0, -2.0, 0.0]


def test_differencing_follows_the_flags(spark, series):
    wide = series({"a": [1, 3, 6], "b": [1, 3, 6]}).withColumnRenamed("value", "x")
    flags = spark.createDataFrame([("a", "x", False), ("b", "x", True)], "entity string, indicator string, is_stationary boolean")
    out = st.difference_columns(wide, ["x"], flags).orderBy("entity", "period_start")
    assert [r["x"] for r in out.collect()] == [None, 2.0, 3.0, 1.0, 3.0, 6.0]


def test_redundant_total(spark):
    rows = [("a", float(i * i + i), float(i * i), float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "entity string, total double, p double, q double")
    assert st.redundant_total(df, "total", ["p", "q"]).first()["is_redundant"]
    assert not st.redundant_total(df.limit(3), "total", ["p", "q"]).first()["is_redundant"]


def test_describe(series):
    out = {r["entity"]: r for r in sm.describe(series({"a": [1, 2, 3, 10], "one": [5]})).collect()}
    a = out["a"]
    assert (a["count"], a["mean"], a["median"], a["min"], a["max"]) == (4, 4.0, 2.5, 1.0, 10.0)
    assert a["std"] == pytest.approx(4.0825, abs=1e-4) and a["skewness"] == pytest.approx(1.7636, abs=1e-3)
    assert out["one"]["std"] is None and out["one"]["skewness"] is None


def test_summary(series):
    values = [10.0] * 12 + [20.0] * 12 + [30.0] * 12 + [15.0] * 12
    out = sm.summarise(series({"a": values}), [("crisis", 2011, 2012)]).first()
    assert (out["peak_value"], out["peak_year"], out["trough_value"], out["trough_year"]) == (30.0, 2012, 10.0, 2010)
    assert out["latest_growth"] == -50.0 and out["overall_change_pct"] == 50.0 and out["trend"] == "increasing"
    assert out["recent_avg_growth"] == pytest.approx((100 + 50 - 50) / 3)
    assert out["crisis_impacts"][0]["mean_value"] == 25.0
