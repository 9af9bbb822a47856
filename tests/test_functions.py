from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicatrix.functions import bands, keys, numeric, tails
from indicatrix.registry import BANDS


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("key, expected", [("2010-07", date(2010, 7, 1)), ("2010-Q3", date(2010, 7, 1)), ("2010", date(2010, 1, 1)), ("2010-13", None), ("2010-Q5", None), ("x", None)])
def test_parse_key(spark, key, expected):
    assert one(spark, keys.parse_key(F.lit(key))) == expected


def test_keys(spark):
    d = F.lit(date(2011, 11, 5))
    assert one(spark, keys.quarter_key(d)) == "2011-Q4"
    assert one(spark, keys.month_key(d)) == "2011-11"
    assert one(spark, keys.period_start(d, "quarter")) == date(2011, 10, 1)
    assert one(spark, keys.add_periods(F.lit(date(2011, 10, 1)), F.lit(2), "quarter")) == date(2012, 4, 1)


def test_clip_keeps_null(spark):
    assert one(spark, numeric.clip(F.lit(None).cast("double"), 0, 100)) is None
    assert one(spark, numeric.clip(F.lit(-3.0), 0, 100)) == 0.0
    assert one(spark, numeric.clip(F.lit(130.0), 0, 100)) == 100.0


def test_null_safe_arithmetic(spark):
    assert one(spark, numeric.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numeric.pct_change(F.lit(3.0), F.lit(2.0))) == 50.0
    assert one(spark, numeric.to_float(F.lit("abc"))) is None
    assert one(spark, numeric.to_float(F.lit("NaN"))) is None
    assert one(spark, numeric.rounded(F.lit(2.1749999999999998))) == 2.17 or one(spark, numeric.rounded(F.lit(2.1749999999999998))) == 2.18
    assert one(spark, numeric.minmax_score(F.lit(4.0), F.lit(4.0), F.lit(4.0))) == 50.0


@pytest.mark.parametrize("value, label", [(3.5, "Strong expansion"), (3.0, "Moderate growth"), (0.0, "Stagnation"), (-1.0, "Contraction"), (None, "Contraction")])
def test_band(spark, value, label):
    assert one(spark, bands.band(F.lit(value).cast("double"), "growth_class")) == label


def test_bands_cover_every_set():
    assert all(rows and fallback for rows, fallback in BANDS.values())


def test_band_null_label(spark):
    assert one(spark, bands.band(F.lit(None).cast("double"), "momentum", null_label=None)) is None


# Published quantiles.
@pytest.mark.parametrize("t, df, p", [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e6, 0.05), (2.750, 30, 0.01), (4.303, 2, 0.05)])
def test_t_tail(t, df, p):
    assert tails.t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(p, rel=2e-3)
    assert tails.t_quantile(np.array([1 - p]), np.array([df]))[0] == pytest.approx(t, rel=2e-3)


@pytest.mark.parametrize("f, d1, d2, p", [(3.098391, 3, 20, 0.05), (4.102821, 2, 10, 0.05), (5.849, 2, 20, 0.01), (161.4476, 1, 1, 0.05)])
def test_f_tail(f, d1, d2, p):
    assert tails.f_upper(np.array([f]), np.array([d1]), np.array([d2]))[0] == pytest.approx(p, rel=2e-3)


def test_tail_nulls(spark):
    df = spark.createDataFrame([(2.228139, 10.0), (None, 10.0)], "t double, df double").select(tails.t_p_value("t", "df").alias("p"))
    got = sorted((r["p"] for r in df.collect()), key=lambda v: (v is None, v))
    assert got[0] == pytest.approx(0.05, rel=1e-3) and got[1] is None


def test_t_quantile_as_an_expression(spark):
    """For odd and even degrees of freedom, few and many, against the bisected incomplete beta function; null without any."""
    rows = [(float(d),) for d in (1, 2, 3, 4, 5, 10, 31, 78, 200, 1001)] + [(0.0,), (None,)]
    df = spark.createDataFrame(rows, "df double")
    for level in (0.5, 0.95, 0.99):
        got = [r["t"] for r in df.select(tails.t_two_sided_quantile(level, F.col("df")).alias("t")).collect()]
        want = tails.t_quantile(np.full(10, level), np.array([r[0] for r in rows[:10]]))
        assert got[:10] == pytest.approx(want.tolist(), rel=1e-7) and got[10:] == [None, None]
