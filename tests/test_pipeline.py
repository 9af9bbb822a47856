import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from indicatrix.operators import benchmark as bm, clean, lineage, quality as dq, scenario as sc
from indicatrix.plans.economy import Warehouse
from indicatrix.plans.pillars import NAMED
from indicatrix.registry import ALERT_RULES, PILLARS
from indicatrix.sources import dims, readers, sinks


def write_raw(folder, pillar, header, rows):
    path = folder / f"raw_{pillar}.csv"
    path.write_text("\n".join([",".join(header)] + [",".join(map(str, r)) for r in rows]) + "\n")
    return path


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    quarters = [(y, q) for y in range(2010, 2026) for q in range(1, 5)]
    months = [(y, m) for y in range(2010, 2026) for m in range(1, 13)]
    def put(pillar, rows):
        return write_raw(folder, pillar, PILLARS[pillar].required_raw, rows)
    gdp = put("gdp", [(f"{y}-{q * 3 - 2:02d}-01", y, q, 40000 + 100 * i, 39000 + 100 * i, 0, 20000 + i) for i, (y, q) in enumerate(quarters)])
    put("unemployment", [(f"{y}-{m:02d}-01", 10 + (i % 7), 30, 5, 70 if i != 5 else "n/a") for i, (y, m) in enumerate(months)])
    put("credit", [(f"{y}-{m:02d}-01", 250000 + i, 150000, 120000, 4) for i, (y, m) in enumerate(months) if i not in (20, 21)])
    put("interest_rates", [(f"{y}-{m:02d}-01", "" if i < 20 else 2, 1, 1.5, 2, 3) for i, (y, m) in enumerate(months)])
    put("inflation", [(f"{y}-{m:02d}-01", 2 + i % 3, 2 + i % 3, 1.5) for i, (y, m) in enumerate(months)])
    put("public_debt", [(f"{y}-{q * 3 - 2:02d}-01", y, q, 200000, 120, -30 if i == 0 else -3) for i, (y, q) in enumerate(quarters[:-1])])
    digest = hashlib.sha256(gdp.read_bytes()).hexdigest()
    (folder / "raw_gdp.csv.sha256").write_text(digest)
    (folder / "raw_credit.csv.sha256").write_text("0" * 64)
    (folder / "raw_gdp.csv.meta.json").write_text(json.dumps({"filename": "raw_gdp.csv", "rows": 64, "columns": "x", "fetched_at": "2026-03-26T10:00:00", "sha256": digest}, indent=1))
    return folder


@pytest.fixture(scope="module")
def facts(spark, raw):
    loaded, status = readers.read_all(spark, str(raw))
    assert {r["status"] for r in status.collect()} == {"loaded"}
    return clean.transform_all(loaded, fetched_at=F.lit("2026-03-26"))


def test_missing_and_incomplete_files(spark, tmp_path):
    assert readers.read_pillar(spark, str(tmp_path), "gdp") is None
    write_raw(tmp_path, "inflation", ["date", "hicp_annual_rate"], [("2010-01-01", 1)])
    with pytest.raises(readers.MissingColumnsError):
        readers.read_pillar(spark, str(tmp_path), "inflation")
    loaded, status = readers.read_all(spark, str(tmp_path))
    assert loaded == {} and {r["pillar"]: r["status"] for r in status.collect()}["inflation"] == "failed"


def test_checksums_and_metadata(spark, raw):
    got = {r["filename"]: r["status"] for r in readers.file_checksums(spark, str(raw)).collect()}
    assert got["raw_gdp.csv"] == "match" and got["raw_credit.csv"] == "mismatch" and got["raw_inflation.csv"] == "unverified"
    meta = readers.read_metadata(spark, str(raw)).first()
    assert meta["pillar"] == "gdp" and meta["fetched_at"].year == 2026


def test_transforms(facts):
    gdp = {r["date_key"]: r for r in facts["gdp"].collect()}
    assert gdp["2010-Q1"]["gdp_growth_qoq"] is None and gdp["2011-Q1"]["gdp_growth_yoy"] == pytest.approx(400 / 39000 * 100, abs=0.005)
    assert gdp["2025-Q4"]["is_provisional"] and not gdp["2025-Q3"]["is_provisional"]
    unemployment = facts["unemployment"].where("date_key = '2010-06'").first()
    assert unemployment["labour_force_participation_rate"] is None and facts["unemployment"].where("is_provisional").count() == 1
    credit = {r["date_key"]: r for r in facts["credit"].collect()}
    assert len(credit) == 192 and credit["2011-09"]["total_credit"] == 250020.0
    assert credit["2010-01"]["credit_nfc"] + credit["2010-01"]["credit_households"] <= credit["2010-01"]["total_credit"] + 0.01
    rates = {r["date_key"]: r["ecb_main_refinancing_rate"] for r in facts["interest_rates"].collect()}
    assert rates["2010-01"] == 1.0 and rates["2011-03"] == 1.0 and rates["2011-06"] == 1.0 and rates["2012-01"] == 2.0
    inflation = facts["inflation"].first()
    assert inflation["cpi_is_estimated"] and inflation["cpi_estimated"] == pytest.approx(inflation["hicp"] - 0.15)
    debt = {r["date_key"]: r for r in facts["public_debt"].collect()}
    assert len(debt) == 64 and debt["2025-Q4"]["total_debt"] == 200000.0 and debt["2010-Q1"]["budget_deficit"] == -25.0
    assert debt["2010-Q3"]["budget_deficit_annual"] is None and debt["2010-Q4"]["budget_deficit_annual"] == -8.5


def test_transform_needs_a_date(spark):
    with pytest.raises(ValueError):
        clean.add_key(spark.createDataFrame([(1.0,)], "hicp double"), "month")


def test_rename_prefers_current_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "nominal_gdp_growth_rate_yoy double, gdp_growth_rate_yoy double")
    assert clean.rename(df, PILLARS["gdp"].rename).columns == ["gdp_growth_yoy", "gdp_growth_rate_yoy"]


def test_named_queries_run_on_loaded_facts(facts):
    wh = Warehouse.from_facts(facts)
    for name in ("gdp_annual_summary", "unemp_trend_ma12", "credit_to_gdp", "macro_dashboard_latest", "annual_snapshot", "consolidation_episodes"):
        out = NAMED[name](wh)
        assert len(out.columns) == len(set(out.columns))
        rows = out.collect()
        assert rows or name == "consolidation_episodes"
    assert len(NAMED["annual_snapshot"](wh).collect()) == 16
    ratio = NAMED["credit_to_gdp"](wh).where("year = 2010 and quarter = 1").first()
    assert ratio["credit_to_gdp_ratio_pct"] == pytest.approx(250002 / 40000 * 100, abs=0.01)


def test_calendar(spark):
    cal = dims.calendar(spark)
    counts = {r["kind"]: r["count"] for r in cal.groupBy(F.when(F.col("month").isNull(), "q").otherwise("m").alias("kind")).count().collect()}
    assert counts == {"m": 192, "q": 64}
    q = cal.where("date_key = '2010-Q1'").first()
    assert q["full_date"] == date(2010, 3, 31) and q["is_quarter_end"]
    assert dims.sources(spark).count() == 5


def test_quality_of_loaded_facts(spark, facts):
    wh = Warehouse.from_facts(facts)
    checks = dq.check_values(wh.monthly, [p for p in PILLARS.values() if p.grain == "month"])
    by_name = {r["check"]: r for r in checks.collect()}
    assert by_name["not_null_inflation_hicp"]["status"] == "pass"
    assert by_name["range_credit_total_credit"]["status"] == "warn" and by_name["range_credit_total_credit"]["affected_rows"] == 192
    assert dq.check_schema(facts["credit"].drop("npl_ratio"), "credit").first()["status"] == "fail"
    with pytest.raises(dq.QualityGateError):
        dq.gate(dq.check_schema(facts["credit"].drop("npl_ratio"), "credit"))
    assert not dq.gate(checks).first()["blocks"]
    assert dq.check_completeness(facts["gdp"], [PILLARS["gdp"]]).first()["status"] == "pass"
    assert dq.check_freshness(facts["gdp"], [PILLARS["gdp"]], 2025).first()["status"] == "pass"
    empty = facts["credit"].withColumn("total_credit", F.lit(None).cast("double"))
    assert {r["check"]: r["status"] for r in dq.check_values(empty, [PILLARS["credit"]]).collect()}["not_null_credit_total_credit"] == "fail"
    document = dq.report_document(checks, "run1").first()
    assert document["summary"]["total"] == len(document["checks"])


def test_outliers_and_drift(spark, series):
    panel = series({"a": [1.0, 1.1, 0.9] * 10 + [9.0], "flat": [1.0] * 20, "short": [1, 2, 90]})
    rows = dq.outliers(panel).collect()
    assert [(r["entity"], r["value"]) for r in rows] == [("a", 9.0)]
    now, before = dq.baseline_stats(series({"a": [2.0, 3.0] * 10, "b": [5.0, 6.0] * 10})), dq.baseline_stats(series({"a": [1.0, 2.0] * 10}))
    assert {r["entity"]: r["status"] for r in dq.drift(now, before).collect()} == {"a": "warn", "b": "baseline"}


def test_alert_rules(spark):
    latest = spark.createDataFrame([("a", "unemployment_rate", 12.5), ("b", "unemployment_rate", 8.0), ("a", "hicp", -0.7), ("a", "debt_to_gdp_ratio", 105.0)],
                                   "entity string, indicator string, value double")
    fired = dq.check_thresholds(latest, dq.alert_rules(spark, ALERT_RULES))
    assert sorted((r["entity"], r["indicator"], r["severity"]) for r in fired.collect()) == [
        ("a", "debt_to_gdp_ratio", "warning"), ("a", "hicp", "warning"), ("a", "unemployment_rate", "critical"), ("a", "unemployment_rate", "warning")]
    assert [r["severity"] for r in fired.orderBy(dq.severity_order()).collect()][0] == "critical"
    assert dq.alert_counts(fired).first()["critical"] == 1


def test_sinks(spark, facts, tmp_path):
    counts = sinks.write_table(facts["gdp"], str(tmp_path / "gdp"), str(tmp_path / "manifest"), "gdp")
    assert counts["rows"] == 64
    manifest = spark.read.parquet(str(tmp_path / "manifest")).first()
    assert manifest["rows"] == 64 and manifest["nulls"] == counts["nulls"]
    assert spark.read.parquet(str(tmp_path / "gdp")).count() == 64
    sinks.append_table(facts["gdp"], str(tmp_path / "gdp"))
    assert spark.read.parquet(str(tmp_path / "gdp")).count() == 128
    sinks.write_table(facts["gdp"].drop("period_start"), str(tmp_path / "csv"), str(tmp_path / "manifest"), "csv", fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 64
    sinks.write_report(dq.report_document(dq.check_completeness(facts["gdp"], [PILLARS["gdp"]]), "r1"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["run_id"] == "r1"
    panel = facts["inflation"].unpivot(["entity", "period_start"], ["hicp", "core_inflation"], "indicator", "value")
    sinks.write_panel(panel, str(tmp_path / "panel"))
    one = spark.read.parquet(str(tmp_path / "panel")).where("indicator = 'hicp'")
    assert one.count() == 192 and "PartitionFilters: [isnotnull(indicator" in one._jdf.queryExecution().executedPlan().toString()


def test_upsert_later_version_wins(spark):
    base = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "entity string, k int, value double")
    updates = spark.createDataFrame([("a", 2, 5.0, 1), ("a", 2, 6.0, 2), ("a", 3, 7.0, 1)], "entity string, k int, value double, version int")
    assert sorted(tuple(r) for r in sinks.upsert(base, updates, ["entity", "k"], "version").collect()) == [("a", 1, 1.0), ("a", 2, 6.0), ("a", 3, 7.0)]
    assert sinks.upsert(base, updates.where("version = 1").drop("version"), ["entity", "k"]).count() == 3


def test_load_fact(spark, facts):
    out = sinks.load_fact(facts["gdp"], "gdp", dims.sources(spark))
    assert out.columns[:3] == ["entity", "date_key", "source_key"] and out.first()["source_key"] == 1
    with pytest.raises(ValueError):
        sinks.load_fact(facts["gdp"].drop("real_gdp"), "gdp", dims.sources(spark))


def test_lineage_tables(spark, facts, tmp_path):
    with lineage.RunTracker(spark, str(tmp_path)) as run:
        with run.stage("transform", "gdp") as counts:
            counts |= {"rows_in": 64, "rows_out": 64}
    with pytest.raises(RuntimeError):
        with lineage.RunTracker(spark, str(tmp_path)) as bad:
            with bad.stage("load", "gdp"):
                raise RuntimeError("boom")
    runs = {r["run_id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/runs").collect()}
    assert runs == {run.run_id: "success", bad.run_id: "failed"}
    stages = spark.read.parquet(f"{tmp_path}/stages")
    assert stages.where("status = 'failed'").first()["error"] == "boom"


def test_scenarios(spark, facts):
    mixed = Warehouse.from_facts(facts).mixed
    base, coefficients = sc.baseline(mixed), sc.calibrate(mixed)
    first = base.first()
    assert first["annual_gdp"] == pytest.approx(sum(40000 + 100 * i for i in range(60, 64)))
    fixed = coefficients.withColumn("okun", F.lit(-0.4))
    fall = sc.output_shock(base, fixed, (-2.0,)).first()
    assert fall["unemployment_change_pp"] == 0.8 and fall["debt_ratio_change_pp"] is not None
    rate = sc.rate_shock(base, fixed, (200.0,)).first()
    assert rate["additional_debt_servicing"] == 4000.0 and rate["spread_widening_bps"] == 80.0
    effort = sc.consolidation(base, (5.0,)).first()
    assert effort["direction"] == "tightening" and effort["gdp_impact_pct"] < 0
    d, years = 120.0, 0
    while d > 60:
        d, years = d * 1.03 / 1.02 - 5.0, years + 1
    assert effort["years_to_target"] == years
    assert sc.consolidation(base, (-9.0,)).first()["years_to_target"] is None


def test_benchmark(spark):
    rows = [(e, "gdp", y, v, False) for e, vs in {"a": [9, 7, 5, 3, 1.5], "b": [1, 1, 1, 1, 1], "c": [0, 0, 0, 0, 0.5]}.items() for y, v in zip(range(2019, 2024), map(float, vs))]
    panel = spark.createDataFrame(rows, "entity string, indicator string, year int, value double, lower_is_better boolean")
    out = {r["entity"]: r for r in bm.compare(panel).collect()}
    assert (out["a"]["rank"], out["b"]["rank"], out["c"]["rank"]) == (1, 2, 3)
    assert out["a"]["trend"] == "converging" and out["a"]["gap_to_average"] == 0.5
    assert bm.rank_history(panel, "c").where("year = 2019").first()["rank"] == 3
    assert bm.peer_pivot(panel, ["a", "c"]).first()["AVG"] == 1.0
    assert {r["entity"]: r["score"] for r in bm.radar(panel).collect()} == {"a": 100.0, "b": 50.0, "c": 0.0}


def test_payload_parsers(spark):
    positional = json.dumps({"dimension": {"time": {"category": {"index": {"2010-01": 0, "2010-02": 1, "2010-03": 2}}}}, "value": {"0": 1.5, "2": 3.0}})
    parallel = json.dumps({"value": [1.0, None, 3.0], "dimension": {"reference_date": {"category": {"index": ["2010-01-31", "2010-02-28", "2010-03-31"]}}}})
    df = spark.createDataFrame([("a", positional, parallel, "2010-01,4.5"), ("b", positional, parallel, "2010-02,oops")], "entity string, p string, q string, line string")
    assert sorted((r["period"], r["value"]) for r in readers.positional_observations(df.limit(1), ["entity"], "p").collect()) == [("2010-01", 1.5), ("2010-03", 3.0)]
    assert readers.parallel_observations(df, ["entity"], "q").count() == 4
    assert [tuple(r) for r in readers.observation_lines(df, ["entity"]).collect()] == [("a", "2010-01", 4.5)]
