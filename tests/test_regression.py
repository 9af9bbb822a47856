from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicatrix.operators import regression as rg
from indicatrix.operators import statistics as st
from indicatrix.plans import statistics as plans


def fit(spark, x, y, regressors):
    names = [f"x{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(x, y)], ", ".join(f"{n} double" for n in [*names, "y"]))
    g = df.groupBy().agg(rg.gram([F.lit(1.0), *map(F.col, names), F.col("y")], F.lit(True)).alias("g"))
    s = g.select(rg.sweep(F.col("g"), regressors).alias("s"))
    return s.select(*[rg.coefficient(F.col("s"), k, len(names) + 1).alias(f"b{k}") for k in range(regressors)], rg.residual_square(F.col("s"), len(names) + 1).alias("rss"),
                    F.col("s.used").alias("used"), F.col("s.a").alias("a")).first()


def test_sweep_is_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (40, 4))
    y = x @ [1.0, -2.0, 0.5, 3.0] + 7 + rng.normal(0, 0.3, 40)
    for regressors in (1, 3, 5):
        design = np.column_stack([np.ones(40), x])[:, :regressors]
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        row = fit(spark, x, y, regressors)
        assert [row[f"b{k}"] for k in range(regressors)] == pytest.approx(beta.tolist(), rel=1e-9)
        assert row["rss"] == pytest.approx(((y - design @ beta) ** 2).sum(), rel=1e-9)
        inverse = np.linalg.inv(design.T @ design)
        assert np.array(row["a"])[:regressors, :regressors] == pytest.approx(inverse, rel=1e-8, abs=1e-12)


def test_redundant_regressors_are_not_used(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (30, 2))
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.full(30, 4.0), np.zeros(30)])
    row = fit(spark, x, x[:, 0] * 2 + 1, 6)
    assert row["used"] == [True, True, True, False, False, False] and row["rss"] == pytest.approx(0, abs=1e-9)
    assert [row[f"b{k}"] for k in range(6)] == pytest.approx([1, 2, 0, 0, 0, 0], abs=1e-9)


def test_unit_root_against_numpy_at_every_length(series):
    """Few values, where fewer lags fit, large levels, and changes that repeat."""
    from test_statistics import brute_adf

    rng = np.random.default_rng(3)
    values = {f"n{n}": list(1e9 + 1e3 * np.cumsum(rng.normal(0, 1, n))) for n in (8, 9, 12, 13, 16, 17, 21, 60)}
    values |= {"seven": [1, 5, 2, 6, 1, 7, 3], "line": [float(k) for k in range(30)], "saw": [float(k % 2) for k in range(30)]}
    out = {r["entity"]: r for r in st.unit_root(series(values)).collect()}
    for name, y in values.items():
        if name.startswith("n"):
            stat, n = brute_adf(y)
            assert out[name]["adf_statistic"] == pytest.approx(stat, abs=2e-3) and out[name]["n_obs"] == n
    assert (out["seven"]["adf_statistic"], out["seven"]["n_obs"]) == (None, 7)
    assert out["saw"]["n_obs"] == 29 and out["line"]["n_obs"] == 29


def test_pairs_use_the_rows_they_share(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, 4))
    x[:, 3] = x[:, 0] + 0.1 * x[:, 3]
    gaps = rng.random((60, 4)) < 0.3
    rows = [("a" if k < 40 else "b", *[None if g else float(v) for v, g in zip(r, gap)]) for k, (r, gap) in enumerate(zip(x, gaps))] + [("empty", 1.0, None, None, 2.0)]
    df = spark.createDataFrame(rows, "entity string, p double, q double, r double, s double")
    got = {(r["entity"], r["a"], r["b"]): r for r in st.pair_correlations(df, ["p", "q", "r", "s"]).collect()}
    assert len(got) == 18
    for entity, part in (("a", slice(0, 40)), ("b", slice(40, 60))):
        for i, a in enumerate("pqrs"):
            for j in range(i + 1, 4):
                both = ~(gaps[part, i] | gaps[part, j])
                row = got[entity, a, "pqrs"[j]]
                assert row["n"] == both.sum() and row["r"] == pytest.approx(np.corrcoef(x[part][both, i], x[part][both, j])[0, 1], abs=1e-4)
    assert (got["empty", "p", "s"]["n"], got["empty", "p", "q"]["n"], got["empty", "p", "q"]["r"]) == (1, 0, None)


def test_pairs_are_summed_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "entity string, p double, q double, r double")
    plan = st.pair_correlations(df, ["p", "q", "r"])._jdf.queryExecution().executedPlan().toString()
    after, before = plan.split("Exchange")  # one, and the aggregates on either side of it
    assert "partial_" not in after and "partial_" in before and before.index("partial_") < before.index("Generate")


def test_redundant_totals_leave_the_matrix(spark):
    """Only for the entity whose total is the sum of its parts, and whose other columns stay."""
    from datetime import date

    rng = np.random.default_rng(5)
    rows = []
    for entity in ("sum", "own"):
        walk = np.cumsum(rng.normal(0, 1, (40, len(plans.MATRIX))), axis=0)
        for k in range(40):
            row = dict(zip(plans.MATRIX, map(float, walk[k])))
            if entity == "sum":
                row["total_credit"] = row["credit_nfc"] + row["credit_households"]
            rows.append((entity, date(2010 + k // 12, k % 12 + 1, 1), *[row[c] for c in plans.MATRIX]))
    wide = spark.createDataFrame(rows, "entity string, period_start date, " + ", ".join(f"{c} double" for c in plans.MATRIX))
    got = plans._matrix(SimpleNamespace(monthly=wide)).collect()
    n = len(plans.MATRIX)
    assert sum(r["entity"] == "own" for r in got) == n * (n - 1) // 2 and sum(r["entity"] == "sum" for r in got) == (n - 1) * (n - 2) // 2
    assert not any(r["entity"] == "sum" and "total_credit" in (r["a"], r["b"]) for r in got)
