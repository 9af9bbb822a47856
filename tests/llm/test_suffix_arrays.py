import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from indicatrix.llm import suffix_arrays as sa

WINDOW = sa.WINDOW


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from all windows of all texts."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[k:k + WINDOW] for _, t in texts for k in range(len(t) - WINDOW + 1))
    out = []
    for d, t in texts:
        gone, reach = bytearray(len(t)), 0
        for k in range(len(t) - WINDOW + 1):
            if seen[t[k:k + WINDOW]] > 1:
                gone[max(k, reach):k + WINDOW] = b"\1" * (k + WINDOW - max(k, reach))
                reach = k + WINDOW
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in sa.repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def coded(strings):
    return np.frombuffer(b"".join(bytes(x + 1 for x in s) + b"\0" for s in strings), np.uint8)


def test_suffix_arrays_and_prefixes():
    """Against sorting all suffixes, also of strings of one letter and of equal strings."""
    rng = random.Random(1)
    for trial in range(150):
        letters = b"ab" if trial % 3 else b"abcdefgh"
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))]
        strings += [b"a" * 50, strings[0], strings[0][1:] + b"a"] if trial % 5 == 0 else []
        t = coded(strings)
        raw = t.tobytes()
        suffix = [raw[k:raw.index(b"\0", k) + 1] for k in range(len(t))]
        order = sa.suffix_array(t)
        assert sorted(order.tolist()) == list(range(len(t))) and [suffix[k] for k in order] == sorted(suffix)
        phi, common = sa.permuted_prefixes(t, order)
        for k, p in enumerate(phi.tolist()):
            if p >= 0:
                a, b = suffix[k][:-1], suffix[p][:-1]
                assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_a_long_run_of_one_byte():
    t = coded([b"x" * 300_000, b"y" * 7, b"x" * 20])
    order = sa.suffix_array(t)
    assert order[3:9].tolist() == [300_000 + 9 + k for k in (19, 18, 17, 16, 15, 14)] or len(set(order[:3])) == 3
    phi, common = sa.permuted_prefixes(t, order)
    assert common.max() == 299_999


def test_whole_table(documents, texts):
    expected = brute(texts)
    assert found(documents) == expected and sum(e[2] for e in expected) > 0


def test_small_chunks_and_shards(documents, texts, monkeypatch):
    monkeypatch.setattr(sa, "CHUNK_BYTES", 5_000)
    monkeypatch.setattr(sa, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(sa, "SHARD_BYTES", 2_000)
    assert found(documents) == brute(texts)


def test_odd_rows(odd_docs, no_docs):
    assert found(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert found(no_docs) == []
    assert sa.repeated_bytes(odd_docs).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]


@pytest.mark.parametrize("size", [199, 200, 201, 399, 400])
def test_lengths_around_the_window(spark, size):
    rng = random.Random(size)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(size))
    rows = [(1, "A" + passage + "B"), (2, "C" + passage), (3, passage[1:] + "D"), (4, passage[:-1]), (5, "é" * 250), (6, "z" * 199), (7, "q" * 200), (8, "w" * 201)]
    assert found(made(spark, rows)) == brute(rows)


def test_ids_at_both_ends_and_repeated_rows(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef ") for _ in range(700)) for _ in range(3)]
    rows = [(2**63 - 1, texts[0]), (-(2**63), texts[1]), (-(2**63), texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[0][:300]), (0, texts[2][100:]), (5, texts[0] + texts[0])]
    assert found(made(spark, rows)) == brute(rows)


def test_a_line_that_all_share(spark, monkeypatch):
    """A hot anchor is avoided in every window that has another one, and windows inside the line still meet."""
    monkeypatch.setattr(sa, "HOT_STRINGS", 5)
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefghijklm ") for _ in range(260))
    rows = [(k, "".join(rng.choice("nopqrst ") for _ in range(150)) + line[:60 if k % 4 else 260] + "".join(rng.choice("nopqrst ") for _ in range(150))) for k in range(60)]
    assert found(made(spark, rows)) == brute(rows)


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """Strings under one anchor with equal hashes are told apart byte by byte."""
    monkeypatch.setattr(sa, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(sa, "mix", lambda x: x * np.uint64(0))
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdef ") for _ in range(230))
    rows = [(k, "".join(rng.choice("abcdef ") for _ in range(300)) + (shared if k < 2 else "")) for k in range(6)]
    assert found(made(spark, rows)) == brute(rows)
