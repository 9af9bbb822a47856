import hashlib
import re

import pytest

from indicatrix.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first, out = {}, []
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, d), d)
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < d:
                gone[k:k + 13] = [True] * 13
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def found(docs):
    return sorted(tuple(r) for r in substrings.repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_words_removed(documents, texts):
    expected = brute(texts)
    assert found(documents) == expected and sum(e[2] for e in expected) > 0


def test_many_chunks(documents, texts, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 30_000)
    assert found(documents) == brute(texts)


def test_odd_rows(odd_docs, no_docs):
    rows = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeated_words(odd_docs).collect())
    assert got == brute(rows)
    assert substrings.repeated_words(no_docs).count() == 0


def test_a_collision_removes_nothing(spark, monkeypatch):
    """With a hash of no bits every window meets every other; verification lets only true repeats through."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    edges = substrings._edges

    def colliding(hashes, before):
        found, at = edges(hashes, before)
        return found * 0, at

    monkeypatch.setattr(substrings, "_edges", colliding)
    assert [r["n_removed"] for r in substrings.repeated_words(docs).collect()] == [0, 0]


def test_cut_texts_keep_their_columns(odd_docs):
    out = substrings.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    kept = {r["doc_id"]: r for r in out.collect()}
    assert (kept[7]["text"], kept[7]["n_chars"]) == ("", 0) and kept[4]["text"] == " \n\t " and kept[6]["n_chars"] == len(kept[6]["text"]) > 20000


def test_white_space_stays_around_a_cut(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, f"One\ttwo\n\n{passage}\nthree  four\n")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs).collect()} == {1: passage, 2: "One\ttwo\n\nthree  four\n"}


@pytest.mark.parametrize("ids", [(2**62 + 1, 2**62 + 1, 2**62), (-(2**63), None, 2**63 - 1), (-(2**63), -(2**63), None), (None, None, 2**63 - 1), (2**63 - 1, 2**63 - 1, -(2**63))])
def test_ids_at_both_ends_of_64_bits(spark, ids):
    """Also repeated and next to null ids, which are smaller than all."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(ids[0], passage + " one"), (ids[1], passage + " two"), (ids[2], "three " + passage), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    below = -(2**63) - 1
    got = sorted((below if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeated_words(docs).collect())
    assert got == brute([(below if d is None else d, t) for d, t in rows])


def test_few_texts_at_a_time(spark, monkeypatch):
    """Whole texts are long rows: a worker gets some of them at a time, however many its task has."""
    monkeypatch.setattr(substrings, "TEXT_ROWS", 7)
    emit, apply = substrings._emit_edges, substrings._apply

    def looked_at(batches):
        for batch in batches:
            if batch.num_rows > 7:
                raise ValueError(f"{batch.num_rows} rows at a time")
            yield batch

    monkeypatch.setattr(substrings, "_emit_edges", lambda *sizes: lambda batches: emit(*sizes)(looked_at(batches)))
    monkeypatch.setattr(substrings, "_apply", lambda batches: apply(looked_at(batches)))
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(k, f"{passage} own{k}" if k % 3 else f"one{k} two") for k in range(100)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
