import hashlib
import re

import pytest
from pyspark.sql import functions as F

from indicatrix.llm import fingerprints


def paragraphs(text):
    return set(re.findall(rf"[^\n]{{1,{fingerprints.PARAGRAPH_CHARS}}}[^\n.!?]*[.!?]*", text))


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 4
        edited = text[:len(text) - k] + following[:k]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, following)))
    return out


def test_against_sets_of_paragraphs(documents, texts):
    rows = fingerprints.fingerprint_documents(documents).collect()
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows)
    for a, b in zip(got, sorted(expected(texts)), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    known, seen = dict(texts), {}
    for r in rows:
        assert seen.setdefault(known[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_peeling_finds_the_differing_digests_and_fails_when_too_small(spark):
    df = spark.createDataFrame([([*range(100, 160)], [*range(104, 163)])], "a array<long>, b array<long>")

    def peeled(cells):
        difference = fingerprints.subtract(fingerprints.sketch(fingerprints.signed(F.col("a"), 1), F.lit(cells)), fingerprints.sketch(fingerprints.signed(F.col("b"), 1), F.lit(cells)))
        return df.select(fingerprints.peel(difference, F.lit(cells)).alias("x")).first()["x"]

    assert sorted((r["s"], r["k"]) for r in peeled(24)) == [(-1, 160), (-1, 161), (-1, 162), (1, 100), (1, 101), (1, 102), (1, 103)]
    assert peeled(6) is None
    # the whole: larger sketches take over where the first is too small
    far = spark.createDataFrame([([*range(200)], [*range(500, 700)])], "a array<long>, b array<long>")
    small = [fingerprints.sketch(fingerprints.signed(F.col(c), 1), F.lit(fingerprints.CELLS)) for c in "ab"]
    assert len(far.select(fingerprints.differing(F.col("a"), F.col("b"), *small).alias("x")).first()["x"]) == 400


def test_odd_rows(odd_docs, no_docs):
    rows = fingerprints.fingerprint_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["n_chars"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    same = [r for r in rows if r["doc_id"] in (6, 7)]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] and max(r["near_next"] for r in same) == 1.0
    assert fingerprints.fingerprint_documents(no_docs).count() == 0
    one = fingerprints.fingerprint_documents(odd_docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_a_line_is_cut_behind_sixty_characters(spark):
    sentence = "This sentence of a long line has some seventy characters, number {}. "
    text = "".join(sentence.format(k) for k in range(4)).strip()
    got = spark.createDataFrame([(text,)], "text string").select(F.size(fingerprints.paragraph_digests(F.col("text"))).alias("n")).first()["n"]
    assert got == 4
