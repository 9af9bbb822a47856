"""Run header and stage records, written as append-only tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

RECORD_SCHEMA = ("run_id string, stage string, pillar string, rows_in bigint, rows_out bigint, null_count bigint, checksum string, "
                 "status string, duration_s double, error string")
RUN_SCHEMA = "run_id string, mode string, started_at timestamp, finished_at timestamp, status string, records bigint"


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach row and null counts and a checksum to a DataFrame; the action that writes it fills them in, without a second pass.

    The checksum adds up hashes of whole rows, so it does not depend on their order or partitions.
    """
    observation = Observation(f"{name}_{uuid.uuid4().hex}")
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    hashes = F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)"))
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"), hashes.alias("hashes")), observation


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach a row count only."""
    observation = Observation(f"{name}_{uuid.uuid4().hex}")
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def checksum(hashes) -> str:
    return f"{int(hashes or 0) % 2**64:016x}"


@dataclass
class RunTracker:
    """Collects stage records of one run and appends them to two tables when the run ends."""

    spark: SparkSession
    folder: str
    mode: str = "full"
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    records: list[tuple] = field(default_factory=list)

    def record(self, stage: str, pillar: str, rows_in: int = 0, rows_out: int = 0, null_count: int = 0, checksum: str | None = None,
               status: str = "success", duration_s: float = 0.0, error: str | None = None) -> None:
        self.records.append((self.run_id, stage, pillar, rows_in, rows_out, null_count, checksum, status, duration_s, error))

    @contextmanager
    def stage(self, name: str, pillar: str) -> Iterator[dict]:
        """Time a stage; the caller puts rows_in, rows_out and null_count into the yielded dict."""
        started, counts = time.monotonic(), {}
        try:
            yield counts
            self.record(name, pillar, duration_s=time.monotonic() - started, **counts)
        except Exception as error:
            self.record(name, pillar, status="failed", duration_s=time.monotonic() - started, error=str(error))
            raise

    def run(self, name: str, pillar: str, source: DataFrame, transform: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]) -> bool:
        """Transform and write one pillar; rows in, rows out, nulls and checksum come from the write itself. A failure is recorded and does not stop the run."""
        try:
            with self.stage(name, pillar) as counts:
                read, rows_in = counted(source, "in")
                out, metrics = observed(transform(read), "out")
                write(out)
                found = metrics.get
                counts |= {"rows_in": int(rows_in.get["rows"]), "rows_out": int(found["rows"]), "null_count": int(found["nulls"]), "checksum": checksum(found["hashes"])}
            return True
        except Exception:
            return False

    def __enter__(self) -> "RunTracker":
        self.started = datetime.now(timezone.utc)
        return self

    def __exit__(self, kind, error, trace) -> None:
        failed = kind is not None or any(r[7] == "failed" for r in self.records)
        header = (self.run_id, self.mode, self.started, datetime.now(timezone.utc), "failed" if failed else "success", len(self.records))
        self.spark.createDataFrame(self.records, RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/stages")
        self.spark.createDataFrame([header], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
