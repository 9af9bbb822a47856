import numpy as np
import pytest
from pyspark.sql import functions as F

from indicatrix.operators import forecast as fc


def scores(spark, actual, predicted):
    rows = [("a", "x", "m", 1, i + 1, float(p), float(q)) for i, (p, q) in enumerate(zip(actual, predicted))]
    df = spark.createDataFrame(rows, "entity string, indicator string, model string, origin int, h int, actual double, predicted double")
    return fc.metrics(df, ["model"]).first()


def test_metrics_known_answers(spark):
    one = scores(spark, [1, 2, 3], [2, 3, 4])
    assert (one["mae"], one["rmse"], one["directional_accuracy_pct"]) == (1.0, 1.0, 100.0)
    assert scores(spark, [100, 200], [110, 220])["mape"] == 10.0
    assert scores(spark, [0, 1], [0.5, 1.5])["mape"] == 50.0
    assert scores(spark, [1, 2, 3], [3, 2, 1])["directional_accuracy_pct"] == 0.0
    assert scores(spark, [1], [2])["directional_accuracy_pct"] is None


def test_direction_is_not_taken_across_origins(spark):
    rows = [("a", "x", "m", o, h, a, a) for o, h, a in ((1, 1, 1.0), (1, 2, 2.0), (2, 1, 9.0), (2, 2, 10.0))]
    df = spark.createDataFrame(rows, "entity string, indicator string, model string, origin int, h int, actual double, predicted double")
    assert fc.metrics(df, ["model"]).first()["directional_accuracy_pct"] == 100.0


def test_perfect_line_has_no_error(series):
    panel = series({"a": list(range(100))})
    out = fc.prefix_forecasts(panel, ["linear"], 4, fc.expanding_origins(20, 4))
    assert fc.metrics(out, ["model"]).first()["mae"] == pytest.approx(0, abs=1e-9)
    fifty = fc.prefix_forecasts(series({"a": list(range(50))}), ["linear"], 4, fc.expanding_origins(20, 4))
    assert fifty.select("origin").distinct().count() == 7


def refit(y, model, horizon):
    t = np.arange(len(y))
    if model == "mean_reversion":
        slope = np.polyfit(y.mean() - y[:-1], np.diff(y), 1)[0]
        k, out, now = max(slope, 0.001), [], y[-1]
        for _ in range(horizon):
            now += k * (y.mean() - now)
            out.append(now)
        return np.array(out)
    b, a = np.polyfit(t, np.log(y) if model == "log_linear" else y, 1)
    line = a + b * np.arange(len(y), len(y) + horizon)
    return np.exp(line) if model == "log_linear" else line


@pytest.mark.parametrize("model", ["linear", "log_linear", "mean_reversion"])
def test_prefix_fits_equal_refits(series, model):
    rng = np.random.default_rng(2)
    y = 50 + np.cumsum(rng.normal(0, 1, 40))
    rows = fc.prefix_forecasts(series({"a": list(y)}), [model], 3, fc.expanding_origins(12, 5)).collect()
    assert rows
    for r in rows:
        assert r["actual"] == y[r["origin"] + r["h"] - 1]
        assert r["predicted"] == pytest.approx(refit(y[:r["origin"]], model, 3)[r["h"] - 1], rel=1e-8)


def test_bands_are_ordered_and_labelled(series):
    rng = np.random.default_rng(4)
    panel = series({"a": list(40 + np.cumsum(rng.normal(0.2, 1, 60)))})
    for out in (fc.linear_trend(panel, 6, "month"), fc.log_linear(panel, 6, "month"), fc.mean_reversion(panel, 6, "month"),
                fc.holt_winters(panel, 6, "month", 12), fc.autoregression(panel, 6, "month")):
        rows = out.orderBy("h").collect()
        assert [r["h"] for r in rows] == [1, 2, 3, 4, 5, 6]
        assert str(rows[0]["period_start"]) == "2015-01-01"
        assert all(r["lower_95"] <= r["lower_68"] <= r["forecast"] <= r["upper_68"] <= r["upper_95"] for r in rows)


def holt_winters_fit(y: np.ndarray, cycle: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Additive level, trend and season on a grid of weights, all combinations advanced together; returns path and residuals."""
    if len(y) < 2 * cycle:
        raise ValueError("series shorter than two cycles")
    grid = np.array([(a, b, g) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.0, 0.05, 0.2) for g in (0.05, 0.2, 0.5)]).T
    alpha, beta, gamma = grid
    first, second = y[:cycle].mean(), y[cycle:2 * cycle].mean()
    level = np.full(grid.shape[1], first)
    trend = np.full(grid.shape[1], (second - first) / cycle)
    season = [np.full(grid.shape[1], y[i] - first) for i in range(cycle)]
    residuals = np.empty((len(y), grid.shape[1]))
    for t, value in enumerate(y):
        s = season[t % cycle]
        residuals[t] = value - (level + trend + s)
        before = level
        level = alpha * (value - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        season[t % cycle] = gamma * (value - level) + (1 - gamma) * s
    best = int(np.argmin((residuals ** 2).sum(axis=0)))
    path = np.array([level[best] + (h + 1) * trend[best] + season[(len(y) + h) % cycle][best] for h in range(horizon)])
    return path, residuals[:, best]


def autoregression_fit(y: np.ndarray, horizon: int, max_p: int = 3, max_d: int = 1) -> tuple[np.ndarray, np.ndarray, tuple[int, int], float]:
    """AR(p) on the d-th difference with the smallest AIC: path, residuals, order and AIC. Orders compete on the same sample."""
    best = None
    for d in range(max_d + 1):
        w = np.diff(y, d) if d else y
        for p in range(max_p + 1):
            skip = max_p + max_d - d
            target = w[skip:]
            if len(target) < p + 5:
                continue
            x = np.column_stack([np.ones(len(target))] + [w[skip - j:len(w) - j] for j in range(1, p + 1)])
            beta, *_ = np.linalg.lstsq(x, target, rcond=None)
            residual = target - x @ beta
            aic = len(target) * np.log(max(float(residual @ residual) / len(target), 1e-300)) + 2 * (p + 2)
            if best is None or aic < best[0]:
                best = (aic, (p, d), beta, residual)
    if best is None:
        raise ValueError("series too short")
    aic, (p, d), beta, residual = best
    w, path = list(np.diff(y, d) if d else y), []
    for _ in range(horizon):
        step = float(beta[0] + sum(beta[j] * w[-j] for j in range(1, p + 1)))
        w.append(step)
        path.append(step)
    out = np.array(path)
    return (y[-1] + np.cumsum(out) if d else out), residual, (p, d), float(aic)


def noisy_season(n, cycle, seed, trend=0.5):
    rng = np.random.default_rng(seed)
    return [100 + trend * t + 8 * np.sin(2 * np.pi * t / cycle) + rng.normal(0, 1.5) for t in range(n)]


def test_holt_winters_follows_a_season(series):
    """The fold against the same grid in numpy, at several lengths, and null below two cycles."""
    values = {f"n{n}": noisy_season(n, 4, n) for n in (8, 9, 11, 40, 83)}
    values |= {"exact": [100 + 2 * t + [10, -5, 0, -5][t % 4] for t in range(40)], "flat": [3.0] * 12, "short": [1.0] * 7}
    rows = fc.holt_winters(series(values), 6, "month", 4).orderBy("entity", "h").collect()
    for name, y in values.items():
        mine = [r for r in rows if r["entity"] == name]
        assert len(mine) == 6
        if name == "short":
            assert all(r["forecast"] is None and r["detail"] for r in mine)
            continue
        path, residual = holt_winters_fit(np.array(y, float), 4, 6)
        assert [r["forecast"] for r in mine] == pytest.approx(path.tolist(), rel=1e-9)
        assert mine[3]["upper_68"] - mine[3]["forecast"] == pytest.approx(2 * np.std(residual, ddof=1), rel=1e-6, abs=1e-9)
    exact = [r["forecast"] for r in rows if r["entity"] == "exact"]
    assert np.abs(np.array(exact[:4]) - [100 + 2 * t + [10, -5, 0, -5][t % 4] for t in range(40, 44)]).max() < 3


def test_order_search_against_refits(series):
    """Order, AIC, path and bands of every series equal least squares in numpy for each order in turn."""
    rng = np.random.default_rng(0)
    stable, walk = [0.0], [5e8]
    for _ in range(200):
        stable.append(0.8 * stable[-1] - 0.3 * (stable[-2] if len(stable) > 1 else 0) + rng.normal())
        walk.append(walk[-1] + 1e5 + 3e4 * rng.normal())
    values = {"stable": stable, "walk": walk, "nine": stable[:9], "ten": stable[:10], "thirteen": walk[:13], "eight": stable[:8], "season": noisy_season(60, 4, 3)}
    panel = series(values)
    fits = {r["entity"]: r for r in fc.autoregression_fits(panel, F.col("t") == F.col("n") - 1, 5).collect()}
    assert fits["eight"]["path"] is None and all(r["forecast"] is None and r["detail"] for r in fc.autoregression(panel.where("entity = 'eight'"), 3, "month").collect())
    for name, y in values.items():
        if name != "eight":
            path, residual, order, aic = autoregression_fit(np.array(y, float), 5)
            assert (fits[name]["p"], fits[name]["d"]) == order and fits[name]["aic"] == pytest.approx(aic, rel=1e-6)
            assert fits[name]["path"] == pytest.approx(path.tolist(), rel=1e-6) and fits[name]["sigma"] == pytest.approx(np.std(residual, ddof=1), rel=1e-6)


def test_origins_use_the_values_before_them(series):
    y = noisy_season(60, 12, 8)
    panel = series({"a": y, "young": y[:30]})
    splits = F.filter(F.array(*[F.col("n") - 12 * k for k in (3, 2, 1)]), lambda o: o >= 12)
    for name, fits, refit_one in (("holt_winters", fc.holt_winters_fits(panel, 12, splits, 12), lambda v: holt_winters_fit(v, 12, 12)[0]),
                                  ("autoregression", fc.autoregression_fits(panel, fc.last_splits(3, 12), 12), lambda v: autoregression_fit(v, 12)[0])):
        rows = fc.split_forecasts(fits, panel, name, 12).collect()
        assert sorted({(r["entity"], r["origin"]) for r in rows}) == [("a", 24), ("a", 36), ("a", 48), ("young", 18)] and len(rows) == 48
        for r in rows:
            assert r["actual"] == y[r["origin"] + r["h"] - 1]
            if (r["entity"], name) == ("young", "holt_winters"):
                assert r["predicted"] is None  # 18 values are less than two cycles
            else:
                assert r["predicted"] == pytest.approx(refit_one(np.array(y[:r["origin"]]))[r["h"] - 1], rel=1e-7)


def test_models_run_without_python(series):
    panel = series({"a": noisy_season(40, 4, 1)})
    for df in (fc.holt_winters(panel, 3, "month", 4), fc.autoregression(panel, 3, "month")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_smoothing_of_a_million_points(spark):
    """Chunks of a recurrence carry their state, and a very long series ends."""
    from indicatrix.operators import folds

    rng = np.random.default_rng(6)
    for n, chunk, alpha in ((0, 4, 0.3), (1, 4, 0.3), (4, 4, 0.3), (5, 4, 1.0), (9, 4, 0.0), (1000, 7, 0.05), (1000, 128, 0.95)):
        y = rng.normal(0, 1, n).tolist()
        s, want = None, []
        for v in y:
            s = v if s is None else alpha * v + (1 - alpha) * s
            want.append(s)
        df = spark.createDataFrame([(y,)], "y array<double>")
        a = F.lit(alpha)
        got = df.select(folds.recurrence(F.transform("y", lambda v: a * v), 1 - a, F.coalesce(F.get("y", F.lit(0)), F.lit(0.0)), chunk).alias("s")).first()["s"]
        assert got == pytest.approx(want, rel=1e-12, abs=1e-12)
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: (i % 97).cast("double")).alias("y"))
    out = long.select(folds.smoothed(F.col("y"), F.lit(0.25)).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
    s = 1.0
    for i in range(2, 1_000_001):
        s = 0.25 * (i % 97) + 0.75 * s
    assert out["n"] == 1_000_000 and out["last"] == pytest.approx(s)


def test_weights_and_ensemble(spark):
    rows = [("a", "x", m, o, 1, 10.0, 10.0 + e) for o in (1, 2) for m, e in (("good", 1.0), ("bad", 3.0))]
    df = spark.createDataFrame(rows, "entity string, indicator string, model string, origin int, h int, actual double, predicted double")
    weights = {r["model"]: r["weight"] for r in fc.model_weights(df).collect()}
    assert weights == {"good": pytest.approx(0.75), "bad": pytest.approx(0.25)}
    perfect = df.withColumn("predicted", F.col("actual"))
    assert {r["weight"] for r in fc.model_weights(perfect).collect()} == {0.5}


def test_user_model_backtest(series):
    out = fc.udf_forecasts(series({"a": list(range(30)), "b": [5] * 30}), "last", lambda y, h: np.repeat(y[-1], h), 2, lambda n: range(10, n - 1, 5))
    m = {r["entity"]: r["mae"] for r in fc.metrics(out, ["entity"]).collect()}
    assert m == {"a": 1.5, "b": 0.0}


def test_best_alpha_is_no_worse_than_its_neighbours(series):
    rng = np.random.default_rng(9)
    y = np.cumsum(rng.normal(0, 1, 60))
    grid = [i / 10 for i in range(1, 10)]

    def sse(alpha):
        s, total = y[0], 0.0
        for v in y[1:]:
            total += (v - s) ** 2
            s = alpha * v + (1 - alpha) * s
        return total

    best = fc.best_alpha(series({"a": list(y)}), grid).first()
    assert best["sse"] == pytest.approx(min(map(sse, grid))) and best["alpha"] == min(grid, key=sse)


def test_debt_path_matches_the_recurrence(spark):
    from datetime import date

    start = spark.createDataFrame([("a", 130.0, 0.01, 0.004, -0.3, 1.5, date(2020, 10, 1)), ("cap", 490.0, 0.05, 0.0, 0.0, 1.0, date(2020, 10, 1))],
                                  "entity string, debt double, r double, g double, pb double, sigma double, last_period date")
    rows = fc.debt_path(start, 8).orderBy("h").collect()
    d = 130.0
    for r in [r for r in rows if r["entity"] == "a"]:
        d = d * 1.01 / 1.004 + 0.3
        assert r["forecast"] == pytest.approx(d)
    assert [r["forecast"] for r in rows if r["entity"] == "cap"] == [500.0] * 8


def test_a_failing_model_leaves_a_trace_and_no_weight(series):
    def sometimes(y, h):
        if len(y) > 15:
            raise ValueError("no fit")
        return np.repeat(y[-1], h)

    panel = series({"a": [float(i % 7) for i in range(30)]})
    failing = fc.udf_forecasts(panel, "failing", sometimes, 2, lambda n: range(10, n - 1, 5))
    assert [r["predicted"] is None for r in failing.orderBy("origin", "h").collect()] == [False] * 4 + [True] * 4
    steady = fc.udf_forecasts(panel, "steady", lambda y, h: np.repeat(y[-1] + 1, h), 2, lambda n: range(10, n - 1, 5))
    assert {r["model"]: r["weight"] for r in fc.model_weights(failing.unionByName(steady)).collect()} == {"failing": 0.0, "steady": 1.0}


def test_short_series_keep_their_rows(series):
    """Two values for a line, one change for a reversion: rows with n and no numbers."""
    panel = series({"one": [3.0], "two": [3.0, 4.0], "three": [3.0, 4.0, 6.0]})
    for out, known in ((fc.linear_trend(panel, 2, "month"), {"three"}), (fc.log_linear(panel, 2, "month"), {"three"}), (fc.mean_reversion(panel, 2, "month"), {"three"})):
        rows = out.collect()
        assert len(rows) == 6 and {r["entity"] for r in rows if r["forecast"] is not None} == known and all(r["n"] is not None for r in rows)
    growth = {r["entity"]: r for r in fc.log_linear_growth(panel, 12).collect()}
    assert len(growth) == 3 and growth["two"]["slope"] is None and growth["two"]["n"] == 2 and growth["three"]["annual_growth"] > 0


def test_a_capped_path_says_so(spark):
    from datetime import date

    start = spark.createDataFrame([("cap", 490.0, 0.05, 0.0, 0.0, 1.0, date(2020, 10, 1)), ("free", 90.0, 0.01, 0.0, 0.0, 1.0, date(2020, 10, 1))],
                                  "entity string, debt double, r double, g double, pb double, sigma double, last_period date")
    rows = fc.debt_path(start, 3).collect()
    assert all(r["is_capped"] == (r["entity"] == "cap") for r in rows) and len(rows) == 6
