"""A training corpus from raw documents: five stages, each on all that the one before kept.

Quality classifier (rejected texts go), near-duplicates (one row of each class stays), repeated passages (cut out of all but their first document), benchmark
passages (their documents go), SentencePiece ids (with the text decoded from them). ORACLE_SQL is None: none of the five has an SQL form; they are
tested against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicatrix.llm import dart_minhash, decontamination, pieces, quality, substrings
from indicatrix.llm.common import TEXT_ROWS, Scratch
from indicatrix.llm.queries import GOOD, piece_model, quality_model


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written here, so that whole texts go to Python TEXT_ROWS at a time."""
    return Scratch(spark, "good", batch_rows=TEXT_ROWS).keep(quality.accepted(docs, quality_model(spark, docs, sf_dir), GOOD), "rows")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.first_of_each(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it where a column has it already (capitals do not count)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, text as decoded, and n_pieces and piece_ids; where docs has columns of these names they stay, and the new ones get an underscore.

    Ids and decoded texts are written one after the other: a task has one Python worker at a time, which gets TEXT_ROWS rows at a time.
    """
    names = [c for c in docs.columns if c != "text"]
    model, scratch = piece_model(), Scratch(spark, "pieces-back", batch_rows=TEXT_ROWS)
    coded = scratch.keep(pieces.decode(scratch.keep(pieces.encode(docs, model, names), "ids"), model), "rows")
    scratch.drop("ids")
    return coded.select(*[F.col("decoded").alias("text") if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns],
                        F.size("ids").alias(free_name("n_pieces", docs.columns)), F.col("ids").alias(free_name("piece_ids", docs.columns)))


STAGES = [("quality classifier", good_texts), ("near-duplicates", one_of_each), ("substring dedup", no_repeats), ("benchmark decontamination", no_benchmark), ("pieces", as_pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder and read back, and dropped when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{number}")
        scratch.drop(f"stage-{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
