import pytest

from indicatrix.llm import quality
from indicatrix.llm.common import doc_bucket


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(corpus, labels):
    model = quality.fit(corpus, labels.where(doc_bucket(labels["doc_id"], 5) != 0))
    held = [r for r in quality.score(corpus, model).join(labels, "doc_id").where(doc_bucket(labels["doc_id"], 5) == 0).collect()]
    assert len(held) > 50
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in held) / len(held)
    assert right > 0.93 and all(r["score"] >= 0.3 for r in held if r["quality"] == 1)


def test_odd_rows(odd_docs, no_docs, corpus, labels):
    model = quality.fit(corpus, labels)
    scores = [r["score"] for r in quality.score(odd_docs, model).collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    kept = quality.accepted(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))
    assert quality.score(no_docs, model).count() == 0


def test_labels_of_one_class_or_none(spark, odd_docs):
    def scores(rows):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        return {r["score"] for r in quality.score(odd_docs, quality.fit(odd_docs, labels)).collect()}

    assert scores([]) == {0.5} and scores([(1, 1), (5, 1), (None, 0), (9, None)]) == {1.0}


def test_an_id_that_repeats_counts_once_in_the_sample(spark):
    docs = spark.range(5000).selectExpr("id % 2 + 1 as doc_id", "concat('text ', id % 50) as text")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    sample = quality.training_sample(docs, labels, "quality").collect()
    assert sorted((r["doc_id"], r["y"]) for r in sample) == [(1, 1), (2, 0)]
    assert sorted(map(str, sample)) == sorted(map(str, quality.training_sample(docs.repartition(7), labels, "quality").collect()))


def test_scores_by_brute_force(spark, corpus, labels):
    """Every score from the two dictionaries by plain Python: compressed sizes, their features and the logistic function."""
    import math

    import zstandard

    model = quality.fit(corpus, labels.where(doc_bucket(labels["doc_id"], 5) != 0))
    sides = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    expected = {}
    for r in corpus.select("doc_id", "text").collect():
        data = (r["text"] or "").encode()
        g, b = (len(side.compress(data)) for side in sides)
        z, short = 10 * (b - g) / (b + g), math.log((min(g, b) + 1) / (len(data) + 12))
        x = [1, z, z * math.log1p(len(data)) / 8, short, short * short]
        expected[r["doc_id"]] = 1 / (1 + math.exp(-sum(w * v for w, v in zip(model.weights, x))))
    got = {r["doc_id"]: r["score"] for r in quality.score(corpus, model).collect()}
    assert got == pytest.approx(expected, abs=1e-9)
