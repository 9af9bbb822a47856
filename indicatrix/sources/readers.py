"""Readers: pillar files with guards, payload parsers, sidecars and checksums."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from indicatrix.functions.keys import parse_key
from indicatrix.functions.numeric import to_float
from indicatrix.registry import PILLARS

#: Larger files are hashed as a stream instead of as one cell.
WHOLE_FILE = 256 << 20
STATUS_SCHEMA = "pillar string, status string, details string"


class MissingColumnsError(ValueError):
    """A raw file lacks columns its pillar requires."""


def raw_types(columns: list[str]) -> dict[str, str]:
    fixed = {"date": "date", "year": "int", "quarter": "int", "month": "int", "entity": "string"}
    return {c: fixed.get(c, "double") for c in columns}


def read_pillar(spark: SparkSession, folder: str, pillar: str) -> DataFrame | None:
    """One raw CSV pillar; None when the file is missing or empty, an error when a required column is.

    Only the header is looked at to decide; every column is then read as text and cast, so a bad cell becomes null.
    """
    path = f"{folder}/raw_{pillar}.csv"
    try:
        text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    except AnalysisException:
        return None
    if not text.columns:
        return None
    missing = [c for c in PILLARS[pillar].required_raw if c not in text.columns]
    if missing:
        raise MissingColumnsError(f"{pillar}: missing columns {missing}")
    kinds = raw_types(text.columns)
    return text.select(*[(to_float(c) if k == "double" else F.expr(f"try_cast(`{c}` as {k})")).alias(c) for c, k in kinds.items()])


def read_all(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every pillar that loads, and a status row for each."""
    loaded, status = {}, []
    for pillar in PILLARS:
        try:
            df = read_pillar(spark, folder, pillar)
        except MissingColumnsError as error:
            status.append((pillar, "failed", str(error)))
            continue
        if df is None:
            status.append((pillar, "missing", "no file"))
        else:
            loaded[pillar] = df
            status.append((pillar, "loaded", f"{len(df.columns)} columns"))
    return loaded, spark.createDataFrame(status, STATUS_SCHEMA)


def streamed_checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file of any size, read through the file system in blocks of 1 MiB: memory does not grow with the file."""
    jvm = spark._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    into = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source.getFileSystem(spark._jsc.hadoopConfiguration()).open(source), into, 1 << 20, True)
    return bytes(digest.digest()).hex()


def file_checksums(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """SHA-256 of every matching raw file, next to the one its sidecar names.

    Files up to WHOLE_FILE bytes are hashed by the tasks that read them, a file a row; the filter on the length keeps larger ones from being read there. Those, which no
    cell could hold, are streamed one after the other, as are empty ones, which a scan leaves out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    sums = files.where(F.col("length") <= WHOLE_FILE).select(name, F.sha2("content", 256).alias("checksum"), F.col("length").alias("size"))
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    listed = [(f.getPath(), f.getLen()) for f in glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or [] if f.isFile()]
    others = [(p.getName(), streamed_checksum(spark, p.toString()), size) for p, size in listed if size > WHOLE_FILE or size == 0]
    if others:
        sums = sums.unionByName(spark.createDataFrame(others, "filename string, checksum string, size long"))
    try:
        sidecars = spark.read.option("wholetext", True).option("pathGlobFilter", f"{pattern}.sha256").text(folder)
    except AnalysisException:
        return sums.withColumn("expected", F.lit(None).cast("string")).withColumn("status", F.lit("unverified"))
    expected = sidecars.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.sha256$", "").alias("filename"),
                               F.regexp_extract("value", r"([0-9a-fA-F]{64})", 1).alias("expected"))
    status = F.when(F.col("expected").isNull(), "unverified").when(F.lower("expected") == F.col("checksum"), "match").otherwise("mismatch")
    return sums.join(expected, "filename", "left").withColumn("status", status)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Fetch metadata sidecars: one JSON object per file."""
    schema = "filename string, rows bigint, columns string, fetched_at string, sha256 string"
    meta = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(folder)
    return meta.withColumn("pillar", F.regexp_extract("filename", r"^raw_(\w+)\.csv$", 1)).withColumn("fetched_at", F.expr("try_cast(fetched_at as timestamp)"))


# ---- payloads -----------------------------------------------------------------------------------------------------

POSITIONAL = T.StructType([
    T.StructField("dimension", T.StructType([T.StructField("time", T.StructType([T.StructField("category", T.StructType([
        T.StructField("index", T.MapType(T.StringType(), T.IntegerType()))]))]))])),
    T.StructField("value", T.MapType(T.StringType(), T.DoubleType())),
])
PARALLEL = T.StructType([
    T.StructField("value", T.ArrayType(T.DoubleType())),
    T.StructField("dimension", T.StructType([T.StructField("reference_date", T.StructType([T.StructField("category", T.StructType([
        T.StructField("index", T.ArrayType(T.StringType()))]))]))])),
])


def positional_observations(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """``{period: position}`` and ``{position: value}`` to rows ``keys, period, value``; positions without a value are dropped.

    The value is looked up in the payload's own map, so nothing is joined.
    """
    parsed = payloads.select(*keys, F.from_json(payload, POSITIONAL).alias("_p"))
    rows = parsed.select(*keys, F.col("_p.value").alias("_values"), F.explode("_p.dimension.time.category.index").alias("period", "_position"))
    value = F.try_element_at(F.col("_values"), F.col("_position").cast("string"))
    return rows.select(*keys, "period", value.alias("value")).where("value is not null")


def observation_lines(lines: DataFrame, keys: list[str], line: str = "line", columns: str = "TIME_PERIOD string, OBS_VALUE string") -> DataFrame:
    """CSV observation lines to ``keys, period, value``; a value that is no number is dropped."""
    parsed = lines.select(*keys, F.from_csv(line, columns).alias("_r"))
    return parsed.select(*keys, F.col("_r.TIME_PERIOD").alias("period"), to_float(F.col("_r.OBS_VALUE")).alias("value")).where("value is not null and period is not null")


def parallel_observations(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Two arrays of one length, dates and values, to rows."""
    parsed = payloads.select(*keys, F.from_json(payload, PARALLEL).alias("_p"))
    pairs = F.arrays_zip(F.col("_p.dimension.reference_date.category.index").alias("period"), F.col("_p.value").alias("value"))
    return parsed.select(*keys, pairs.alias("_z")).select(*keys, F.inline("_z")).toDF(*keys, "period", "value").where("value is not null")


def with_period_start(df: DataFrame, key: Column | str = "period") -> DataFrame:
    return df.withColumn("period_start", parse_key(F.col(key) if isinstance(key, str) else key))
