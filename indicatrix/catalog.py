"""Every registered query by name, and its SQL form where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from indicatrix.oracle.base import half_up
from indicatrix.plans import pillars
from indicatrix.plans.economy import economy

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = ["cleaning", "panels", "summaries", "statistics", "quality", "benchmarking", "forecasts", "scenarios",
            "briefings", "measures", "charts", "ingest"]


def _on_economy(plan) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(economy(spark, sf_dir))

    run.__name__ = plan.__name__
    return run


def queries() -> dict[str, Query]:
    out = {name: _on_economy(plan) for name, plan in pillars.NAMED.items()}
    for family in FAMILIES:
        out |= import_module(f"indicatrix.plans.{family}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(import_module("indicatrix.oracle.pillars").SQL)
    for family in FAMILIES:
        out |= getattr(import_module(f"indicatrix.oracle.{family}"), "SQL")
    return {name: half_up(text) for name, text in out.items()}
