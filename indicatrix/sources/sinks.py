"""Writers and loaders: tables with a manifest, upserts, facts with source keys, JSON reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from indicatrix.functions.numeric import to_float
from indicatrix.operators.lineage import observed
from indicatrix.registry import PILLARS


#: Partitions that one merge may rewrite.
MAX_TOUCHED = 10_000


def write_table(df: DataFrame, path: str, manifest: str, name: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                fmt: str = "parquet") -> dict:
    """Write a table and append a manifest row with its counts, which the write itself collects."""
    counted, observation = observed(df, f"write_{name}")
    writer = counted.write.mode(mode).partitionBy(*partition_by) if partition_by else counted.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    counts = observation.get
    row = (name, path, int(counts["rows"]), int(counts["nulls"]), ",".join(df.columns))
    df.sparkSession.createDataFrame([row], "name string, path string, rows bigint, nulls bigint, columns string").coalesce(1).write.mode("append").parquet(manifest)
    return counts


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def write_report(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested rows to JSON lines."""
    document.write.mode(mode).json(path)


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite", parts: int = 16) -> None:
    """Long panel as Parquet partitioned by indicator, so a query on a few indicators reads only their folders; ``parts`` files of entities each."""
    panel.repartition("indicator", F.pmod(F.xxhash64("entity"), F.lit(parts))).write.mode(mode).partitionBy("indicator").parquet(path)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Rows of ``base`` replaced by those of ``updates`` with the same key; among updates the highest ``version`` wins.

    One aggregation per key over both sides: a single shuffle with map-side combine, no join and no window.
    """
    values = [c for c in base.columns if c not in keys]
    order = F.col(version) if version else F.lit(0)
    both = base.select(*keys, F.struct(*values).alias("_row"), F.struct(F.lit(0).alias("is_update"), F.lit(None).cast(dict(updates.dtypes).get(version, "int")).alias("v")).alias("_rank")).unionByName(
        updates.select(*keys, F.struct(*values).alias("_row"), F.struct(F.lit(1).alias("is_update"), order.alias("v")).alias("_rank")))
    return both.groupBy(*keys).agg(F.max_by("_row", "_rank").alias("_row")).select(*keys, "_row.*")


def merge_partitions(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], partition: str, version: str | None = None) -> int:
    """Upsert into a Parquet table partitioned by one of its keys, rewriting only the partitions that the updates touch; how many those are.

    The touched values are found first (at most MAX_TOUCHED; updates that touch more are a reload). The scan of the table is pruned to them, and a dynamic overwrite replaces their
    folders, so that the rest of the table is neither read nor written. A value the table does not have becomes a new partition.
    """
    if partition not in keys:
        raise ValueError(f"{partition} must be one of the keys {list(keys)}: a row would stay behind in its old partition")
    touched = [r[0] for r in updates.select(partition).distinct().limit(MAX_TOUCHED + 1).collect()]
    if len(touched) > MAX_TOUCHED:
        raise ValueError(f"updates touch more than {MAX_TOUCHED} partitions; write the table anew")
    if any(v is None for v in touched):
        raise ValueError(f"updates without {partition} have no partition")
    merged = merged_rows(spark, path, updates, keys, partition, touched, version)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return len(touched)


def merged_rows(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], partition: str, touched: Sequence, version: str | None = None) -> DataFrame:
    """The touched partitions after the upsert, from a scan of these alone."""
    base = spark.read.parquet(path).where(F.col(partition).isin(list(touched)))
    return upsert(base, updates, keys, version).select(*base.columns)


def load_fact(df: DataFrame, pillar: str, sources: DataFrame) -> DataFrame:
    """Fact rows ready for the warehouse: source key looked up by name, values coerced, columns in schema order."""
    spec = PILLARS[pillar]
    missing = [c for c in spec.columns if c not in df.columns]
    if missing:
        raise ValueError(f"{pillar}: missing columns {missing}")
    named = df if "source_name" in df.columns else df.withColumn("source_name", F.lit(spec.source_name))
    joined = named.join(sources.select("source_name", "source_key"), "source_name", "left")
    flag = F.col("is_provisional") if "is_provisional" in df.columns else F.lit(False)
    extra = [c for c in spec.extra_columns if c in df.columns]
    return joined.select("entity", "date_key", "source_key", *[to_float(F.col(c)).alias(c) for c in spec.columns], *extra, flag.alias("is_provisional"))
