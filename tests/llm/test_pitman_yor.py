import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicatrix.llm import pitman_yor
from indicatrix.llm.common import doc_bucket


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def expected(rows, held):
    count = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens(text))
    total, kinds = sum(count.values()), len(count)
    return sorted((d or 0, h, len(w := tokens(text)), sum(count[t] > 0 for t in w), total, round(sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in w), 6)) for (d, text), h in zip(rows, held))


def digest(out):
    return sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)


@pytest.mark.parametrize("chunk", [20_000, 8 << 20])
def test_counts_base_and_perplexity(documents, texts, monkeypatch, chunk):
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", chunk)
    out = pitman_yor.score_documents(documents, doc_bucket(F.col("doc_id"), 7) == 2).collect()
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts]
    assert digest(out) == expected(texts, held)
    unseen = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) and all(r["score"] < 0 for r in out)


def test_probabilities_sum_to_one(spark):
    """All texts over the known words and one unknown have probability 1 together.

    With b(x) = P("x") and q(x, y) = P("x y") / P("x"), texts of n words have the sum b Q^(n-1) 1, so all have P("") + b (I - Q)^-1 1, from scores alone.
    """
    train = [(k, t) for k, t in enumerate(["a b", "a b", "a c", "b a c", "c c c", "a"])]
    words = ["a", "b", "c", "unknown"]
    asked = ["", *words, *[f"{x} {y}" for x in words for y in words]]
    docs = spark.createDataFrame(train + [(100 + k, t) for k, t in enumerate(asked)], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(docs, F.col("doc_id") >= 100).collect()}
    p = {t: 10 ** out[100 + k] for k, t in enumerate(asked)}
    b = np.array([p[x] for x in words])
    q = np.array([[p[f"{x} {y}"] / p[x] for y in words] for x in words])
    assert p[""] + b @ np.linalg.solve(np.eye(len(words)) - q, np.ones(len(words))) == pytest.approx(1, abs=1e-4)
    assert p["b"] > p["unknown"] and p["a b"] > p["a unknown"]


def test_words_before_are_contexts_of_their_own(spark, monkeypatch):
    """"coming" and "mowing" end alike, so they are one class; what follows each of them must still be told apart, however rows are cut into chunks."""
    train = [(k, t) for k, t in enumerate(["coming home", "mowing grass"] * 90)]
    asked = ["coming home", "coming grass", "mowing home", "mowing grass", "sewing home", "sewing grass", ""]
    docs = spark.createDataFrame(train + [(1000 + k, t) for k, t in enumerate(asked)], "doc_id long, text string").repartition(3, "doc_id")
    scores = []
    for chunk in (1, 8 << 20):
        monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", chunk)
        out = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(docs, F.col("doc_id") >= 1000).collect()}
        scores.append([out[1000 + k] for k in range(len(asked))])
    p = dict(zip(asked, scores[0]))
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)
    assert p["coming home"] > p["coming grass"] + 1 and p["mowing grass"] > p["mowing home"] + 1
    assert abs(p["sewing home"] - p["sewing grass"]) < 0.3


class Restaurant:
    """A Pitman-Yor restaurant, customer by customer: tables of each dish by their sizes. Without one above, dishes are drawn from so many words and one unknown."""

    def __init__(self, above, discount, words, rng):
        self.above, self.discount, self.words, self.rng = above, discount, words, rng
        self.tables: dict = {}
        self.seated = 0

    def chance(self, dish):
        sizes = self.tables.get(dish, [])
        new = (1 + self.discount * sum(map(len, self.tables.values()))) * (self.above.chance(dish) if self.above else 1 / (self.words + 1))
        return (sum(sizes) - self.discount * len(sizes) + new) / (1 + self.seated)

    def enter(self, dish):
        sizes = self.tables.setdefault(dish, [])
        old = [n - self.discount for n in sizes]
        place = self.rng.choices(range(len(sizes) + 1), [*old, self.chance(dish) * (1 + self.seated) - sum(old)])[0]
        self.seated += 1
        if place < len(sizes):
            sizes[place] += 1
        else:
            sizes.append(1)
            if self.above:
                self.above.enter(dish)

    def leave(self, dish):
        sizes = self.tables[dish]
        place = self.rng.choices(range(len(sizes)), sizes)[0]
        sizes[place] -= 1
        self.seated -= 1
        if not sizes[place]:
            del sizes[place]
            if self.above:
                self.above.leave(dish)


def discount(counts):
    one, two = counts.count(1), counts.count(2)
    return min(0.95, max(0.05, one / max(1, one + 2 * two)))


def gibbs(texts, asked, burn_in, sweeps):
    """log10 probabilities of texts by a sampler that takes every customer out and seats it again, one by one, in restaurants of words, classes and the parent."""
    rng = random.Random(4)
    links = [(w, u) for t in texts for u, w in zip([None, *tokens(t)], tokens(t))]
    words, of = len({w for w, _ in links}), lambda u: u and (u[-3:], min(len(u), 4))
    parent = Restaurant(None, 0.5, words, rng)
    classes = {of(u): Restaurant(parent, 0.5, words, rng) for _, u in links}
    low = discount(list(Counter(links).values()))
    leaves = {u: Restaurant(classes[of(u)], low, words, rng) for _, u in links}
    for w, u in links:
        leaves[u].enter(w)
    chance = [0.0] * len(asked)
    for turn in range(burn_in + sweeps):
        for r, below in ((parent, classes.values()), *((k, [x for x in leaves.values() if x.above is k]) for k in classes.values())):
            assert r.seated == sum(len(s) for x in below for s in x.tables.values())
        for group in ([parent], classes.values()):
            estimate = discount([sum(s) for r in group for s in r.tables.values() if s])
            for r in group:
                r.discount = estimate
        for w, u in links:
            leaves[u].leave(w)
            leaves[u].enter(w)
        if turn >= burn_in:
            for k, (w, u) in enumerate(asked):
                chance[k] += leaves.get(u, classes.get(of(u), parent)).chance(w) / sweeps
    return [math.log10(x) for x in chance]


def test_tables_of_every_restaurant_are_seated(spark):
    """A word that follows "coming" sixty times has several tables there, so it is more likely behind "sewing", of the same class, than one that follows it once: as likely as a full sampler says."""
    train = [*(f"coming w{k}" for k in range(8) for _ in range(60)), *(f"coming z{k}" for k in range(40)), *(f"p{k} r{k}" for k in range(15) for _ in range(2))]
    asked = [*(f"sewing w{k}" for k in range(8)), *(f"sewing z{k}" for k in range(8))]
    docs = spark.createDataFrame([*enumerate(train), *((1000 + k, t) for k, t in enumerate(asked))], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(docs, F.col("doc_id") >= 1000).collect()}
    pairs = [[(w, u) for u, w in zip([None, *tokens(t)], tokens(t))] for t in asked]
    links = sorted({p for ps in pairs for p in ps}, key=str)
    chance = dict(zip(links, gibbs(train, links, 10, 30)))
    got, want = np.array([out[1000 + k] for k in range(16)]), np.array([sum(chance[p] for p in ps) for ps in pairs])
    assert got.reshape(2, 8).mean(1) == pytest.approx(want.reshape(2, 8).mean(1), abs=0.25)
    assert got[:8].mean() > got[8:].mean() + 0.6


def test_seating():
    rng = np.random.default_rng(0)
    assert pitman_yor.seat(np.array([1, 1]), np.array([5.0, 0.1]), 0.5, rng).tolist() == [1, 1]
    many = pitman_yor.seat(np.full(4000, 10), np.full(4000, 2.0), 0.0, rng).mean()
    assert many == pytest.approx(sum(2 / (2 + n) for n in range(10)), rel=0.03)  # the table count of a Dirichlet process
    large = pitman_yor.seat(np.full(200, 100_000), np.full(200, 2.0), 0.0, rng).mean()
    assert large == pytest.approx(sum(2 / (2 + n) for n in range(100_000)), rel=0.05)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = pitman_yor.score_documents(odd_docs, F.col("doc_id") % 2 == 1).collect()
    assert digest(out) == expected(rows, [bool(d is not None and d % 2 == 1) for d, _ in rows])
    assert pitman_yor.score_documents(no_docs, F.lit(False)).count() == 0
    nothing = pitman_yor.score_documents(odd_docs, F.lit(True)).collect()
    assert len(nothing) == len(rows) and {r["train_tokens"] for r in nothing} == {0} and all(math.isfinite(r["score"]) for r in nothing)
