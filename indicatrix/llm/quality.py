"""Quality of texts by compression: two zstandard dictionaries, one of good and one of bad texts, and a calibrated difference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicatrix.llm.common import doc_texts

#: The classifier is fitted on so many labelled rows of each class at most, none of them longer than so many characters. Every text is scored whole.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 20_000
DICT_BYTES, LEVEL = 64 * 1024, 3


@dataclass(frozen=True)
class Classifier:
    """good, bad: zstandard dictionaries. weights: of the features; None where labels of a class are missing."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] | None
    prior: float


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """text and y of a bounded sample: of each class, the labelled documents with the smallest id hashes.

    Labels that are null or neither 0 nor 1 do not count, nor do documents whose labels differ. Repeated labels count once.
    Of an id with several texts the one with the smallest hash counts, so the sample has one row for each id at most, however often an id repeats.
    """
    one = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)") \
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = one.where("y = 1").orderBy(*order).limit(rows).union(one.where("y = 0").orderBy(*order).limit(rows))
    texts = doc_texts(docs).where(F.char_length("text").between(1, chars))
    met = texts.join(F.broadcast(chosen), "doc_id")  # 2 * rows ids at most
    return met.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short texts for a trained one: their own bytes serve
        return b"\n".join(texts)[-DICT_BYTES:]


def _compressor(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


def _features(texts: list[bytes], good, bad) -> np.ndarray:
    """1, the normalised size difference (bad - good) / (bad + good), its product with the log length, and how far either dictionary shortens the text."""
    g = np.array([len(good.compress(t)) for t in texts], float)
    b = np.array([len(bad.compress(t)) for t in texts], float)
    z = 10 * (b - g) / (b + g)
    length = np.array([len(t) for t in texts], float)
    short = np.log((np.minimum(g, b) + 1) / (length + 12))
    return np.stack([np.ones(len(texts)), z, z * np.log1p(length) / 8, short, short**2], axis=1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small ridge so that separable classes have an end."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Classifier:
    """Fit on a bounded sample (SAMPLE_ROWS, SAMPLE_CHARS): two thirds build the dictionaries, one third the calibration.

    With labels of one class or none, every score is the share of good labels, or a half without any.
    """
    rows = training_sample(docs, labels, label).orderBy(F.xxhash64("doc_id"), "doc_id", "text").toPandas()
    texts, y = [t.encode() for t in rows["text"]], rows["y"].to_numpy(float)
    if len(set(y)) < 2:
        return Classifier(b"", b"", None, float(y.mean()) if len(y) else 0.5)
    turn = np.zeros(len(y), int)  # the place of a row in its own class
    for value in (0, 1):
        turn[y == value] = np.arange((y == value).sum())
    build = turn % 3 < 2
    good, bad = (_dictionary([t for t, mine in zip(texts, build & (y == value)) if mine]) for value in (1, 0))
    held = ~build if len(set(y[~build])) == 2 else np.ones(len(y), bool)
    x = _features([t for t, mine in zip(texts, held) if mine], _compressor(good), _compressor(bad))
    return Classifier(good, bad, _calibrate(x, y[held]), float(y.mean()))


def _with_scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """row (a struct of all columns) and score."""
    source = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = (_compressor(model.good), _compressor(model.bad)) if model.weights else None
        for big in batches:
            for batch in (big.slice(k, 256) for k in range(0, big.num_rows, 256)):
                texts = [t.encode() for t in batch.column("text").to_pylist()]
                p = 1 / (1 + np.exp(-np.clip(_features(texts, *pair) @ np.array(model.weights), -700, 700))) if pair else np.full(len(texts), model.prior)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p, pa.float64())], names=["row", "score"])

    return source.mapInArrow(scored, T.StructType([source.schema["row"], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id and score of every row: how likely the text is good, 0 to 1, from the text alone.

    Null texts count as empty, and the empty text has a score like any other. Long texts are compressed whole. Rows repeat as they do in docs.
    """
    return _with_scores(docs.select("doc_id", "text"), model).select(F.col("row.doc_id").cast("long").alias("doc_id"), "score")


def accepted(docs: DataFrame, model: Classifier, least: float) -> DataFrame:
    """The rows of docs whose score is at least so much, with all their columns."""
    return _with_scores(docs, model).where(F.col("score") >= least).select(*[F.col("row")[c].alias(c) for c in docs.columns])
