"""Plans: what a query reads, windows without keys, and medians of groups that no task could hold."""

import importlib.util
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from indicatrix.operators.summaries import describe, describe_large
from indicatrix.plans.economy import economy

SF_DIR = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("plan_report", Path(__file__).resolve().parent.parent / "tools" / "plan_report.py")
report = importlib.util.module_from_spec(spec)
spec.loader.exec_module(report)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")
def test_a_panel_of_one_rate_reads_no_lines(spark):
    keys = ["entity", "grain", "period_start", "date_key"]
    assert "lineitem" not in plan(economy(spark, SF_DIR).mixed.select(*keys, "unemployment_rate"))
    assert "lineitem" in plan(economy(spark, SF_DIR).mixed.select(*keys, "total_credit"))
    assert economy(spark, SF_DIR).shared("unemployment_rate").monthly.columns == ["entity", "period_start", "date_key", "unemployment_rate"]


def test_keyless_windows_are_counted(spark):
    from pyspark.sql import Window

    df = spark.range(5).withColumn("k", F.col("id") % 2)
    assert report.keyless_windows(plan(df.withColumn("n", F.row_number().over(Window.orderBy("id"))))) == 1
    assert report.keyless_windows(plan(df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id"))))) == 0


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_large_groups_have_the_statistics_of_small_ones(spark, bins):
    """Half of all rows hold one value; groups of even, odd and single size, and one of nulls."""
    rows = spark.range(400).select((F.col("id") % 4).alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.pmod(F.hash("id"), F.lit(97)).cast("double")).alias("value"))
    extra = spark.createDataFrame([(9, 1.5), (10, None), (11, 2.0), (11, 3.0)], "g long, value double")
    rows = rows.unionByName(extra)
    small = {r["g"]: r for r in describe(rows.where("value is not null"), by=("g",)).collect()}
    large = {r["g"]: r for r in describe_large(rows.where("value is not null"), by=("g",), bins=bins).collect()}
    assert small == large and set(small) == {0, 1, 2, 3, 9, 11}


def test_calendars_reach_as_far_as_the_facts(spark, tmp_path):
    from pathlib import Path

    from pyspark.sql import functions as F

    from indicatrix import catalog

    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if path.stem != "orders":
            (tmp_path / path.name).symlink_to(path)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    moved = F.expr("case when o_orderkey % 2 = 0 then o_orderdate - interval 120 month else o_orderdate + interval 120 month end").cast(orders.schema["o_orderdate"].dataType)
    orders.withColumn("o_orderdate", moved).write.parquet(str(tmp_path / "orders.parquet"))
    queries = catalog.queries()
    facts = queries["facts_with_calendar"](spark, str(tmp_path))
    years = facts.agg(F.min("year").alias("a"), F.max("year").alias("b"), F.count_if(F.col("full_date").isNull()).alias("n")).first()
    assert years["a"] < 1990 and years["b"] > 2005 and years["n"] == 0
    assert queries["explorer_rows"](spark, str(tmp_path)).agg(F.max("year")).first()[0] > 2005
    last = spark.read.parquet(str(tmp_path / "orders.parquet")).agg(F.last_day(F.max("o_orderdate").cast("date"))).first()[0]
    assert queries["policy_steps"](spark, str(tmp_path)).agg(F.max("period_end")).first()[0] == last
    assert queries["calendar_dimension"](spark, str(tmp_path)).agg(F.max("year")).first()[0] == last.year
    assert queries["orphan_months"](spark, str(tmp_path)).where("date_key is not null").count() > 0


def test_months_outside_the_calendar_are_orphans(spark, tmp_path):
    """Orders before the calendar, at both its ends, after it and without a day; the facts' own months must not make the calendar."""
    import duckdb

    from indicatrix import catalog

    days = ["1994-12-31", "1995-01-01", "2001-06-30", "2001-06-29", "2001-07-01", "2001-08-01", None]
    tables = {"orders": spark.createDataFrame([(k, 1, d, 10.0, "O", "5-LOW") for k, d in enumerate(days)], "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double, o_orderstatus string, o_orderpriority string")
              .withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")),
              "lineitem": spark.createDataFrame([(k, 1, 5.0, 100.0, 0.1, 0.1, "N") for k in range(len(days))], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"),
              "customer": spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey int"), "nation": spark.createDataFrame([(1, "A")], "n_nationkey int, n_name string")}
    con = duckdb.connect()
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    (row,) = catalog.queries()["key_checks"](spark, str(tmp_path)).collect()
    assert tuple(row[c] for c in ("entity", "keys", "duplicate_keys", "orphan_keys")) == ("A", 6, 0, 4)
    assert con.sql(catalog.oracle_sql()["key_checks"]).fetchall() == [("A", 6, 0, 4)]
