from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, one id with two texts, and columns that clash with inner names."""
    long_text = " ".join(f"word{i % 977} of{i % 13}" for i in range(9000)) + "." + "x" * 20000
    rows = [(1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70, 0.1, "k"), (2, None, None, None, None, None, None),
            (3, "", "en", "a", 0, 0.2, None), (4, " \n\t ", "en", "a", 4, None, "k"), (5, "one", "en", "b", 3, 0.3, "k"), (6, long_text, "en", "b", len(long_text), 0.4, "k"),
            (7, long_text, "en", "b", len(long_text), 0.4, "k"), (8, "repeat me " * 50, "en", "b", 500, 0.5, "k"), (8, "repeat me " * 50, "en", "b", 500, 0.5, "k"),
            (9, "first text of nine", "en", "c", 18, None, "k"), (9, "second text of nine", "en", "c", 19, None, "k"), (None, "a text without an id", "de", "c", 20, 0.6, "k"),
            (10, "ünïcödé 漢字 🙂 " * 8, "xx", "c", 120, 0.7, "k"), (11, "<|endoftext|> Don't stop.", "en", "c", 24, 0.8, "k")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text) in ascending order of doc_id."""
    return sorted((r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect())
