from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
from indicatrix.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Build a panel from {entity: [values]}: one row per month from 2010-01."""
    from datetime import date

    def build(values: dict[str, list], indicator: str = "x"):
        rows = [(e, indicator, date(2010 + i // 12, i % 12 + 1, 1), None if v is None else float(v)) for e, vs in values.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "entity string, indicator string, period_start date, value double")

    return build
