import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from indicatrix.llm import dart_minhash
from indicatrix.llm.common import Scratch


def shingles(text):
    w = text.split()
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def likeness(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(rows):
    """Smallest doc_id of each class, by all pairs that share a shingle."""
    bags, parent, where = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (bag, (_, text)) in enumerate(zip(bags, rows)):
        near = {j for s in bag for j in where[s]}
        near |= {j for j in range(i) if rows[j][1] == text}
        for j in near:
            if rows[j][1] == text or likeness(bag, bags[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in bag:
            where[s].append(i)
    return sorted((d, rows[find(i)][0]) for i, (d, _) in enumerate(rows))


def found(spark, docs):
    return sorted((r["doc_id"], r["class_id"]) for r in dart_minhash.near_classes(docs, Scratch(spark, "test-near")).collect())


def test_classes(spark, documents, texts):
    assert found(spark, documents) == brute(texts)


@pytest.mark.parametrize("block", [3, 1000])
def test_large_groups_of_near_copies_in_small_blocks(spark, monkeypatch, block):
    """A star: copies are near the base but not each other; a chain; and a group of small changes. Small blocks must give what one block gives."""
    monkeypatch.setattr(dart_minhash, "BLOCK", block)
    rng = random.Random(7)
    base = [f"s{k}" for k in range(120)]
    rows = [" ".join(base)]
    for k in range(12):
        w = base.copy()
        w[9 * k + 4], w[9 * k + 8] = f"new{k}", f"other{k}"
        rows.append(" ".join(w))
    chain = [f"c{k}" for k in range(100)]
    rows += [" ".join(chain[k:k + 60]) for k in range(0, 25, 5)]
    rows += [" ".join(rng.choices("abcdefgh", k=60)) for _ in range(10)]
    rows += ["x y z"] * 2 + ["", "", " "]
    rng.shuffle(rows)
    pairs = list(enumerate(rows))
    assert found(spark, spark.createDataFrame(pairs, "doc_id long, text string")) == brute(pairs)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(2)
    for share in (0.3, 0.6, 0.9):
        a = [rng.choice("abcdef") + str(rng.randint(0, 30)) for _ in range(400)]
        b = a[:int(400 * share)] + [f"z{k}" for k in range(400 - int(400 * share))]
        flat, bounds = dart_minhash.elements(pa.array([" ".join(a), " ".join(b)]))
        signature = dart_minhash.signatures(flat, bounds)
        exact = dart_minhash.similarity(*(np.sort(flat[x:y]) for x, y in zip(bounds, bounds[1:])))
        assert exact == pytest.approx(likeness(shingles(" ".join(a)), shingles(" ".join(b))))
        assert abs((signature[0] == signature[1]).mean() - exact) < 0.2


def test_odd_rows(spark, odd_docs, no_docs):
    got = [(r["doc_id"], r["class_id"]) for r in dart_minhash.near_classes(odd_docs, Scratch(spark, "test-near")).collect()]
    assert len(got) == odd_docs.count() and (7, 6) in got and (2, 2) in got and (4, 4) in got and (8, 8) in got
    assert found(spark, no_docs) == []
    kept = dart_minhash.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 8, 9, 9, 10, 11]


def test_columns_named_like_the_keys_come_back_unchanged(spark):
    names = ["__doc", "__text", "__id", "__key", "row", "doc", "digest", "text_key", "label", "root"]
    rows = [(d, t, *[f"{n}-{d}" for n in names]) for d, t in ((1, "a b c"), (2, "a b c"), (3, None), (None, "d e"), (None, "d e"), (4, ""))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    kept = dart_minhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id != 2").distinct().collect()))


def test_pairs_of_a_block_are_small(monkeypatch):
    """Near copies agree in all pairs of a block: a pair takes few bytes, not a row of long numbers and Python objects."""
    n = 800
    texts = [" ".join(f"w{i}" for i in range(60)) + f" own{k}" for k in range(n)]
    monkeypatch.setattr(dart_minhash, "signatures", lambda items, bounds: np.zeros((len(bounds) - 1, dart_minhash.COORDINATES), np.uint64))
    tracemalloc.start()
    try:
        found = dart_minhash.merged_labels(texts, list(range(n)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(found) == [(k, 0) for k in range(1, n)]
    assert peak < 64 * n * (n - 1) / 2
