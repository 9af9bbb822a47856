"""Helpers of this folder: scratch tables in the shared folder and the meaning of a word."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indicatrix.session import ensure_checkpoint_dir

#: A word is a longest run of characters other than these six; the same set for every operator that counts words.
WHITE = " \t\n\x0b\x0c\r"
#: Rows of whole texts that go to a Python worker at a time where a table is written with this limit.
TEXT_ROWS = 1000
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, text never null; whatever other columns there are stay behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """The words of a text as an array, in order; an empty array for an empty text."""
    plain = F.translate(text, WHITE, " " * len(WHITE))
    return F.array_remove(F.split(plain, " "), "")


def doc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo a number of buckets: how held-out rows are named."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Tables of one call below the folder that spark.checkpoint.dir names; they outlive executors and are dropped when no longer read.

    free_shuffles: once a table is written, Spark removes the shuffle files that it was made from, which nothing reads again.
    batch_rows: while a table is written, at most so many rows go to a Python worker at a time; whole texts are long rows, held by executor and worker alike.
    """

    def __init__(self, spark: SparkSession, name: str, free_shuffles: bool = False, batch_rows: int | None = None):
        self.spark = spark
        self.options = {_FREE: "true"} if free_shuffles else {}
        if batch_rows:
            self.options[_BATCH] = str(batch_rows)
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write a table and read it back: a cut in the lineage that survives the loss of executors. by names columns whose values have a folder each."""
        before = {k: self.spark.conf.get(k, None) for k in self.options}
        for k, v in self.options.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(self.path(name))
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
