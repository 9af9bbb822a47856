"""Registered queries of this folder, each one operator over its whole table, and the SQL forms of those that have one."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicatrix.llm import ball_search, dart_minhash, decontamination, fingerprints, licenses, pieces, pitman_yor, quality, shards, simplex_clusters, substrings, suffix_arrays, token_files
from indicatrix.llm.common import Scratch, doc_bucket

#: A text of at least this score counts as good.
GOOD = 0.3

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(_table(spark, sf_dir, "documents"), piece_model())


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Classifier:
    """Learnt from the labelled rows that are not held out."""
    return quality.fit(docs, _table(spark, sf_dir, "labels").where(doc_bucket(F.col("doc_id"), 5) != 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model(spark, docs, sf_dir)
    return quality.score(docs, model).select("doc_id", (doc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = shards.even_tree()
    return shards.shard_documents(_table(spark, sf_dir, "documents"), tree, shards.with_shard(tree, "region1", "rack1.1", 16))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return token_files.written_index(_table(spark, sf_dir, "documents"), vocabulary, end_id=1)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(_table(spark, sf_dir, "documents"), Scratch(spark, "near")).select("doc_id", "class_id")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(_table(spark, sf_dir, "documents"), doc_bucket(F.col("doc_id"), 7) == 2)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.repeated_bytes(_table(spark, sf_dir, "documents")).drop("spans")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_clusters.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {"op1_pieces": op1_pieces, "op2_substrings": op2_substrings, "op3_licenses": op3_licenses, "op4_quality": op4_quality, "op5_decontamination": op5_decontamination, "op6_shards": op6_shards, "op7_token_files": op7_token_files, "op8_fingerprints": op8_fingerprints, "op9_near_duplicates": op9_near_duplicates, "op10_language_model": op10_language_model, "op11_ranked_search": op11_ranked_search, "op12_repeated_bytes": op12_repeated_bytes, "op13_clusters": op13_clusters}

ORACLE_SQL: dict[str, str] = {"op3_licenses": licenses.oracle_sql(), "op11_ranked_search": ball_search.oracle_sql(), "op13_clusters": simplex_clusters.oracle_sql()}
