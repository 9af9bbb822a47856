from datetime import date

import pytest
from pyspark.sql import functions as F

from indicatrix.operators import lineage, quality as dq
from indicatrix.sources.state import VersionedTable


def panel(spark, values):
    rows = [(e, "x", date(2010 + i // 12, i % 12 + 1, 1), float(v)) for e, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "entity string, indicator string, period_start date, value double")


def test_two_runs_and_a_third(spark, tmp_path):
    """The first run has no baseline, each later one the statistics of the run before; reports stay as they were."""
    state = VersionedTable(spark, str(tmp_path / "baseline"))
    assert state.read() is None and state.versions() == []
    steady, jump = [10 + i % 3 for i in range(12)], [20 + i % 3 for i in range(12)]
    first = dq.drift_run(panel(spark, {"a": steady, "b": steady, "short": [1.0] * 9}), state)
    second = dq.drift_run(panel(spark, {"a": steady, "b": jump, "new": steady}), VersionedTable(spark, str(tmp_path / "baseline")))
    third = dq.drift_run(panel(spark, {"a": steady, "b": jump}), state)
    status = [{r["entity"]: r["status"] for r in out.collect()} for out in (first, second, third)]
    assert status == [{"a": "baseline", "b": "baseline"}, {"a": "pass", "b": "warn", "new": "baseline"}, {"a": "pass", "b": "pass"}]
    assert state.versions() == [1, 2, 3] and {r["entity"]: r["median"] for r in state.read(2).collect()} == {"a": 11.0, "b": 21.0, "new": 11.0}


def test_a_broken_write_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "baseline")
    state = VersionedTable(spark, folder)
    state.commit(spark.range(3))
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        state.commit(broken)
    spark.range(9).write.parquet(f"{folder}/data/7")  # written, but never switched to
    assert state.versions() == [1] and state.read().count() == 3 and state.read(7) is None
    assert state.commit(spark.range(5)) == 8 and VersionedTable(spark, folder).read().count() == 5


def test_two_commits_of_one_number(spark, tmp_path):
    """The second of two runs that took the same number fails, and the first one's version stays."""
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    numbers = two._numbers
    one.commit(spark.range(1))
    two._numbers = lambda name: []
    two.versions = lambda: []
    with pytest.raises(Exception):
        two.commit(spark.range(2))
    assert numbers("markers") == [1] and one.read().count() == 1


def test_records_come_from_the_write(spark, tmp_path):
    """Rows, nulls, status, duration and checksum of every stage; a failing pillar is recorded and the others run."""
    source = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, name string")
    with lineage.RunTracker(spark, str(tmp_path / "runs")) as tracker:
        assert tracker.run("transform", "one", source, lambda d: d.where("id > 1"), lambda out: out.write.parquet(str(tmp_path / "one")))
        assert not tracker.run("transform", "two", source, lambda d: d.select("missing"), lambda out: out.write.parquet(str(tmp_path / "two")))
        assert not tracker.run("transform", "three", source, lambda d: d.withColumn("id", F.raise_error(F.lit("broken"))), lambda out: out.write.parquet(str(tmp_path / "three")))
        assert tracker.run("transform", "four", source.orderBy(F.desc("id")).repartition(3), lambda d: d.where("id > 1"), lambda out: out.write.parquet(str(tmp_path / "four")))
    rows = {r["pillar"]: r for r in spark.read.parquet(str(tmp_path / "runs/stages")).collect()}
    one = rows["one"]
    assert (one["rows_in"], one["rows_out"], one["null_count"], one["status"]) == (3, 2, 1, "success") and one["duration_s"] > 0 and len(one["checksum"]) == 16
    assert rows["two"]["status"] == rows["three"]["status"] == "failed" and "broken" in rows["three"]["error"] and rows["two"]["checksum"] is None
    assert rows["four"]["checksum"] == one["checksum"]
    assert spark.read.parquet(str(tmp_path / "runs/runs")).first()["status"] == "failed"
