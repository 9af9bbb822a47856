"""Ingest operators on payloads that Spark builds from the tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from indicatrix.functions.numeric import as_cents, rounded
from indicatrix.operators import quality as dq
from indicatrix.plans.cleaning import raw_from
from indicatrix.plans.economy import economy, table
from indicatrix.registry import PILLARS
from indicatrix.session import ensure_checkpoint_dir
from indicatrix.sources import readers, sinks
from indicatrix.sources.dims import sources


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered array of (period, value) per entity: at most one element per month."""
    monthly = economy(spark, sf_dir).monthly.select("entity", "date_key", "npl_ratio")
    return monthly.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("date_key", "npl_ratio"))).alias("obs"))


def positional_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _series(spark, sf_dir)
    keys = F.transform("obs", lambda o, i: F.struct(o["date_key"].alias("key"), i.cast("int").alias("value")))
    values = F.filter(F.transform("obs", lambda o, i: F.struct(i.cast("string").alias("key"), o["npl_ratio"].alias("value"))), lambda e: e["value"].isNotNull())
    payload = F.to_json(F.struct(
        F.struct(F.struct(F.struct(F.map_from_entries(keys).alias("index")).alias("category")).alias("time")).alias("dimension"), F.map_from_entries(values).alias("value")))
    return readers.positional_observations(obs.select("entity", payload.alias("payload")), ["entity"])


def parallel_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _series(spark, sf_dir)
    payload = F.to_json(F.struct(
        F.col("obs.npl_ratio").alias("value"), F.struct(F.struct(F.struct(F.col("obs.date_key").alias("index")).alias("category")).alias("reference_date")).alias("dimension")))
    out = readers.parallel_observations(obs.select("entity", payload.alias("payload")), ["entity"])
    return readers.with_period_start(out)


def observation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as text; prices of pending orders are not numbers and are dropped."""
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    lines = orders.select("o_orderkey", F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM"), price).alias("line"))
    tidy = readers.observation_lines(lines, ["o_orderkey"])
    return tidy.groupBy("period").agg(F.count("*").alias("n"), F.sum(as_cents("value")).alias("cents"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON field of the event stream as a typed column."""
    events = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return events.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))


def upserted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restated values for 2001: of two versions of a month the later wins, other months stay."""
    base = economy(spark, sf_dir).shared("unemployment_rate").monthly.select("entity", "date_key", "unemployment_rate")
    late = base.where(F.col("date_key") >= "2001-01")
    first = late.withColumn("version", F.lit(1)).withColumn("unemployment_rate", F.col("unemployment_rate") + 1)
    second = late.where(F.col("date_key") >= "2001-04").withColumn("version", F.lit(2)).withColumn("unemployment_rate", F.col("unemployment_rate") + 2)
    new = late.where(F.col("date_key") == "2001-01").withColumn("version", F.lit(1)).withColumn("date_key", F.lit("2002-01"))
    return sinks.upsert(base, first.unionByName(second).unionByName(new), ["entity", "date_key"], "version")


def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the size of the orders: urgent orders are restated."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), F.col("o_totalprice"), F.lit(1).alias("version"))
    out = sinks.upsert(orders, urgent, ["o_orderkey"], "version")
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(as_cents("o_totalprice")).alias("cents"))


def loaded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values arrive as text with bad cells, the source by name; an unknown source has no key."""
    monthly = economy(spark, sf_dir).monthly
    text = monthly.select(
        "entity", "date_key", *[F.when(F.month("period_start") == 6, "bad").otherwise(F.col(c).cast("string")).alias(c) for c in ("hicp", "cpi_estimated", "core_inflation")],
        F.when(F.month("period_start") == 7, "nobody").otherwise("Eurostat").alias("source_name"))
    return sinks.load_fact(text, "inflation", sources(spark))


def explorer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact with its calendar columns, as exported from the data explorer."""
    from indicatrix.operators.joins import with_calendar
    from indicatrix.sources.dims import calendar_of

    fact = economy(spark, sf_dir).fact("public_debt")
    return with_calendar(fact.drop("period_start"), calendar_of(fact)).select("entity", "date_key", "full_date", "year", "quarter", "total_debt", "debt_to_gdp_ratio",
                                                                                   rounded("budget_deficit").alias("budget_deficit"))


def extracted_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files of all pillars, written and read back with their guards and metadata: rows, known values and totals, and the schema check of each."""
    wh = economy(spark, sf_dir).shared(*[c for p in PILLARS.values() for c in p.columns])
    folder = f"{ensure_checkpoint_dir(spark)}/raw-{uuid4().hex}"
    for p in PILLARS:
        raw_from(wh, p).write.option("header", True).csv(f"{folder}/raw_{p}.csv")
    loaded, status = readers.read_all(spark, folder)
    out = None
    for p, df in loaded.items():
        lead = {new: old for old, new in reversed(PILLARS[p].rename.items())}.get(PILLARS[p].columns[0], PILLARS[p].columns[0])
        one = df.agg(F.lit(p).alias("pillar"), F.count("*").alias("rows"), F.count(lead).alias("known"), rounded(F.sum(lead)).alias("total"))
        one = one.join(dq.check_schema(wh.fact(p), p).select("pillar", F.col("status").alias("schema_status")), "pillar")
        out = one if out is None else out.unionByName(one)
    return out.join(status.select("pillar", F.col("status").alias("read_status")), "pillar")


def page_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 and size of every stored page."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html"), 256).alias("checksum"), F.octet_length("html").cast("long").alias("size"))


def upserted_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders kept by year, with those of two years restated: only their partitions are rewritten."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))
    path = f"{ensure_checkpoint_dir(spark)}/orders-{uuid4().hex}"
    orders.repartition("year").write.partitionBy("year").parquet(path)
    late = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and year(o_orderdate) in (1996, 1998)").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.year("o_orderdate").alias("year"))
    sinks.merge_partitions(spark, path, late, ["o_orderkey", "year"], "year")
    return spark.read.parquet(path).groupBy("year", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(as_cents("o_totalprice")).alias("cents"))


QUERIES = {f.__name__: f for f in (positional_payload, parallel_payload, observation_lines, event_props, upserted_facts, upserted_orders, loaded_facts, explorer_rows,
                                  extracted_pillars, page_digests, upserted_partitions)}
