"""Quality checks, alerts and lineage on the stand-in economies."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from indicatrix.functions.numeric import rounded
from indicatrix.operators import joins, quality as dq
from indicatrix.operators.lineage import RunTracker
from indicatrix.plans.cleaning import raw_from, transform_raw
from indicatrix.plans.economy import Warehouse, economy, table, to_panel
from indicatrix.plans.panels import user_days
from indicatrix.registry import ALERT_RULES, PILLARS
from indicatrix.session import ensure_checkpoint_dir
from indicatrix.sources.dims import calendar
from indicatrix.sources.state import VersionedTable

MONTHLY = [p for p in PILLARS.values() if p.grain == "month"]
QUARTERLY = [p for p in PILLARS.values() if p.grain == "quarter"]
CHECKED = [c for p in MONTHLY for c in p.columns]
VALUES = [c for p in PILLARS.values() for c in p.columns]
ALERTED = sorted({rule[0] for rule in ALERT_RULES})
# Fixed dates, as the calendar table's are: one made from the facts would know every key of theirs, and no key could be an orphan.
CALENDAR = ("1995-01-01", "2001-06-30")


def _panel(wh: Warehouse) -> DataFrame:
    return to_panel(wh.monthly, CHECKED).where("value is not null")


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(economy(spark, sf_dir).shared(*VALUES))


def _values(wh: Warehouse) -> DataFrame:
    return dq.check_values(wh.monthly, MONTHLY).unionByName(dq.check_values(wh.quarterly, QUARTERLY))


def range_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq.range_extremes(economy(spark, sf_dir).monthly, CHECKED)


def completeness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completeness(economy(spark, sf_dir))


def _completeness(wh: Warehouse) -> DataFrame:
    return dq.check_completeness(wh.monthly, MONTHLY).unionByName(dq.check_completeness(wh.quarterly, QUARTERLY))


def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq.check_consistency(economy(spark, sf_dir).monthly)


def freshness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest keys against the year that the calendar of the orders ends in."""
    wh = economy(spark, sf_dir)
    end = table(spark, sf_dir, "orders").agg(F.max(F.year("o_orderdate")).alias("end_year"))
    return dq.check_freshness(wh.monthly, MONTHLY, end).unionByName(dq.check_freshness(wh.quarterly, QUARTERLY, end))


def outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unusual user days of the event stream."""
    days = user_days(spark, sf_dir).select("entity", "period_start", "value")
    return dq.outliers(days, by=("entity",)).withColumn("z", rounded("z", 4))


def outlier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq.outlier_report(_panel(economy(spark, sf_dir)), threshold=2.5)


def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batch runs on one stored baseline: a first one on the years before 1999, which has none yet, and the one reported, on the years from 1999."""
    panel = _panel(economy(spark, sf_dir).shared(*CHECKED)).withColumn("late", F.year("period_start") >= 1999)
    state = VersionedTable(spark, f"{ensure_checkpoint_dir(spark)}/drift-{uuid4().hex}")
    dq.drift_run(panel.where(~F.col("late")), state)
    return dq.drift_run(panel.where("late"), state)


def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness of (entity, date_key), and keys that the warehouse's calendar does not know; a null key is one of them."""
    monthly = economy(spark, sf_dir).monthly.select("entity", "date_key")
    known = calendar(spark, *CALENDAR).select("date_key", F.lit(1).alias("known"))
    keys = monthly.groupBy("entity", "date_key").agg(F.count("*").alias("n"))
    return keys.join(F.broadcast(known), "date_key", "left").groupBy("entity").agg(
        F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.count_if(F.col("known").isNull()).alias("orphan_keys"))


def missing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps inside each customer's own quarters."""
    from indicatrix.plans.panels import customer_quarters

    dense = joins.densify(customer_quarters(spark, sf_dir).select("entity", "period_start"), grain="quarter")
    return dense.groupBy("entity").agg(F.count("*").alias("expected"), F.count_if("is_filled").alias("missing")).where("missing > 0")


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = economy(spark, sf_dir).shared(*VALUES)
    return dq.roll_up(_values(wh).unionByName(dq.check_consistency(wh.monthly)).unionByName(_completeness(wh)))


def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = to_panel(economy(spark, sf_dir).mixed, ALERTED).where("value is not null")
    latest = known.groupBy("entity", "indicator").agg(F.max("period_start").alias("period_start"), F.max_by("value", "period_start").alias("value"))
    alerts = dq.check_thresholds(latest, dq.alert_rules(spark, ALERT_RULES))
    return alerts.orderBy(dq.severity_order(), "entity", "indicator")


def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq.alert_counts(threshold_alerts(spark, sf_dir), by=("entity",))


def user_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rules on the event stream: share of errors on each user's last day."""
    days = user_days(spark, sf_dir)
    latest = days.groupBy("entity").agg(F.max("period_start").alias("period_start"),
                                        F.max_by(100.0 * F.col("n_errors") / F.col("n_events"), "period_start").alias("value")).withColumn("indicator", F.lit("error_share"))
    rules = dq.alert_rules(spark, [("error_share", "Errors (%)", "warning", "above", 20.0), ("error_share", "Errors (%)", "critical", "above", 50.0)])
    return dq.check_thresholds(latest, rules)


def lineage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage records of a run that transforms and writes all six pillars, read from the run's own table (which has checksums and durations besides)."""
    wh = economy(spark, sf_dir).shared(*VALUES)
    folder = f"{ensure_checkpoint_dir(spark)}/lineage-{uuid4().hex}"
    with RunTracker(spark, folder) as tracker:
        for p in PILLARS:
            tracker.run("transform", p, raw_from(wh, p), lambda raw, p=p: transform_raw(raw, p), lambda out, p=p: out.write.parquet(f"{folder}/{p}"))
    return spark.read.parquet(f"{folder}/stages").select("stage", "pillar", "rows_in", "rows_out", "null_count", "status")


QUERIES = {f.__name__: f for f in (
    value_checks, range_extremes, completeness_checks, consistency_checks, freshness_checks, outlier_rows, outlier_summary,
    drift_check, key_checks, missing_periods, quality_summary, threshold_alerts, alert_summary, user_alerts, lineage_records)}
