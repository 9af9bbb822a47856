import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from indicatrix.llm import ball_search as bs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score long, rank int, doc_id long"


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    counts = [(d, Counter(words(t))) for d, t in docs]
    full = [(d, c) for d, c in counts if c]
    n_docs, total = len(full), sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    queries = {}
    for item, text in {(i, t) for i, t in items if t is not None}:
        queries.setdefault(item, Counter()).update(words(text))
    out = []
    for item, query in queries.items():
        scored = []
        for d, c in full:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(k * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in query.items() if t in c)
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:20])]
    return sorted(out, key=str)


def found(docs, items):
    return sorted((tuple(r) for r in bs.top_documents(docs, items).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], ITEMS)


def test_whole_tables(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(bs, "LEAF", 4)
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    got = found(documents, benchmark)
    assert got == brute(texts, items) and len(got) == 20 * len(items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "The QUICK brown fox, the fox!"), (1, "The QUICK brown fox, the fox!"), (2, None), (3, ""), (4, " .,;\x00 "), (5, "nowhere to be seen"), (6, "漢字 ÜNÏCÖDÉ"), (6, "one text"),
             (None, "repeat me"), (7, "word1 " * 3000 + "of2"), (-(2**63), "text"), (2**63 - 1, "endoftext 🙂")]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs, made(spark, items)) == brute(rows, items)
    assert found(no_docs, made(spark, items)) == [] and found(odd_docs, made(spark, [])) == []


def test_groups_ties_and_small_steps(spark, monkeypatch):
    """Forty equal texts under equal and different ids, groups of one item, trees of few documents, texts cut into steps."""
    monkeypatch.setattr(bs, "ITEM_BYTES", 20)
    monkeypatch.setattr(bs, "SEGMENT_BYTES", 7)
    monkeypatch.setattr(bs, "CHUNK_DOCS", 16)
    monkeypatch.setattr(bs, "LEAF", 2)
    rng = random.Random(3)
    some = ["alpha", "Beta", "gamma", "delta9", "été", "longer-word-in-parts", "x" * 300]
    docs = [(k % 30, "alpha beta  gamma") for k in range(40)] + [(100 + k, " ".join(rng.choice(some) for _ in range(rng.randrange(40)))) for k in range(150)]
    items = [(k, " ".join(rng.choice(some) for _ in range(5))) for k in range(6)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), made(spark, items)) == brute(docs, items)


def test_nothing_above_the_least_score_is_pruned():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 30, 500)
    bounds = np.append(0, np.cumsum(lengths))
    term = np.concatenate([np.sort(rng.choice(200, n, replace=False)) for n in lengths])
    value = rng.integers(1, 1_000_000, len(term))
    tree = bs.Tree(bounds, term, value)
    rows = np.repeat(np.arange(500), lengths)
    for _ in range(30):
        query, weight = np.sort(rng.choice(200, 12, replace=False)), rng.integers(0, 9000, 12)
        dense = np.zeros(200, np.int64)
        dense[query] = weight
        true = np.bincount(rows, dense[term] * value.astype(float), 500).astype(np.int64)
        at = np.searchsorted(tree.names, query)
        bound = tree.bound(at, weight)
        assert all(true[tree.order[tree.low[k]:tree.high[k]]].max() <= bound[k] for k in range(len(bound)))
        best = bs.Best()
        bs.search(tree, np.arange(500), np.zeros(500, bool), query, weight, best)
        order = np.lexsort((np.arange(500), -true))[:20]
        assert best.doc.tolist() == order[true[order] > 0].tolist() and best.score.tolist() == true[order][true[order] > 0].tolist()


def test_a_tree_prunes():
    """Documents about other things are not scored."""
    lengths = np.full(640, 5)
    topic = np.repeat(np.arange(20), 32)
    term = (topic[:, None] * 10 + np.arange(5)).ravel()
    tree, best = bs.Tree(np.append(0, np.cumsum(lengths)), term, np.full(len(term), 1000)), bs.Best()
    assert bs.search(tree, np.arange(640), np.zeros(640, bool), np.array([30, 31]), np.array([7, 8]), best) <= 128
    assert best.doc.tolist() == list(range(96, 116))


def test_equal_hashes_are_told_apart(monkeypatch):
    """A word with a term's hash that is another word is not counted."""
    monkeypatch.setattr(bs, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    known, _ = bs.vocabulary({b"abc", b"de"})
    n, text, term, count = bs.count_terms(pa.array(["abc xyz de ABC", "ed"]), known)
    assert (n.tolist(), text.tolist(), count.tolist()) == ([4, 1], [0, 0], [1, 2]) and known.lengths[term].tolist() == [2, 3]
    with pytest.raises(ValueError):
        bs.vocabulary({b"abc", b"xyz"})


def test_large_counts():
    """The mean length in integers of 64 bits, and beyond them."""
    n, count = np.array([10**9, 5]), np.array([10**9, 1])
    for documents in (10**8, 10**12):
        got = bs.impacts(count, n, documents, 10**14)
        assert got.tolist() == [10**9 * c // (1000 * c + 12 * (75 + 25 * k * documents // 10**14)) for c, k in ((10**9, 10**9), (1, 5))]
