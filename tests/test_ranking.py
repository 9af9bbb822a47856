from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from indicatrix.operators import benchmark as bm
from indicatrix.operators import joins
from indicatrix.operators.ranking import number_large_groups, rank_peers


@pytest.fixture(scope="module")
def tied(spark):
    """One group of 4,000 rows, half of them with one value, a small group, and nulls."""
    rows = [("big", f"e{k:05d}", 7.0 if k % 2 else float(k % 50), k % 3 == 0) for k in range(4000)] + [("small", e, v, False) for e, v in (("x", 1.0), ("y", 2.0), ("z", None))]
    return spark.createDataFrame(rows, "g string, entity string, value double, low boolean")


@pytest.mark.parametrize("lower", [False, True])
def test_numbers_equal_a_window_over_the_whole_group(tied, lower):
    got = {(r["g"], r["entity"]): r["rank"] for r in number_large_groups(tied, ["g"], lower_is_better=lower, parts=7).collect()}
    want = {(r["g"], r["entity"]): r["rank"] for r in rank_peers(tied.where("value is not null"), ["g"], lower_is_better=lower).collect()}
    assert {k: v for k, v in got.items() if k[1] != "z"} == want and got["small", "z"] == 3


def test_no_task_has_the_whole_group(spark, tied):
    """Each of the ranges, also of those inside the tied value, has a part of the group."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = number_large_groups(tied, ["g"], parts=8)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 3000
    assert "_range" in plan


def test_comparison_of_large_groups(spark):
    rows = [(f"e{k}", i, y, float((k * (y - 2018)) % 5), i == "low") for k in range(60) for i in ("low", "high") for y in range(2019, 2024) if not (k == 9 and y == 2023)]
    panel = spark.createDataFrame(rows, "entity string, indicator string, year int, value double, lower_is_better boolean")
    for f in (bm.compare, bm.rank_history):
        plain, large = (sorted(tuple(r) for r in f(panel, **how).collect()) for how in ({}, {"ranker": number_large_groups}))
        assert plain == large and plain
    assert "e9" not in {r["entity"] for r in bm.compare(panel).collect()}


def test_as_of_spreads_one_entity(spark):
    """One entity with all rows: the step function is right, and its rows lie in several tasks."""
    days = [date(2020, 1, 1) + timedelta(days=k) for k in range(0, 700, 3)]
    changes = spark.createDataFrame([("a", d, None if k % 10 == 4 else float(k)) for k, d in enumerate(days)], "entity string, change_date date, rate double")
    ends = [date(2019, 12, 31)] + [date(2020 + k // 12, k % 12 + 1, 28) for k in range(30)]
    spine = spark.createDataFrame([(e, d) for e in ("a", "none") for d in ends], "entity string, period_end date")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = joins.as_of(changes, spine, "rate")
        got = out.withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    known = [(d, float(k)) for k, d in enumerate(days) if k % 10 != 4]
    want = {d: ([v for at, v in known if at <= d] or [None])[-1] for d in ends}
    assert {r["period_end"]: r["rate"] for r in got if r["entity"] == "a"} == want
    assert len(got) == 62 and all(r["rate"] is None for r in got if r["entity"] == "none")
    assert len({r["p"] for r in got if r["entity"] == "a"}) > 1
