import math
import zlib
from collections import Counter

import xxhash

from indicatrix.llm import shards


def placed(docs, tree=None, grown=None):
    tree = tree or shards.even_tree()
    return shards.shard_documents(docs, tree, grown or shards.with_shard(tree, "region1", "rack1.1", 16)).collect()


def test_slots_sizes_and_checksums(documents, texts):
    rows, known = placed(documents), dict(texts)
    for r in rows:
        data = known[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert len(rows) == len(texts)


def chosen(key, weights):
    """The shard with the smallest exponential draw of all, hashed here by the xxhash library: the smallest of each subtree on the way down is the smallest of all."""
    start = 42 if key is None else xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
    bits = {s: xxhash.xxh64(f"shard:{s}".encode(), seed=start).intdigest() >> 12 for s in weights}
    return min(weights, key=lambda s: -math.log((bits[s] + 0.5) / 2**52) / weights[s])


def test_shards_against_plain_draws(spark):
    ids = [*range(3000), None, -5, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(d, "x") for d in ids], "doc_id long, text string")
    even = {s: 1.0 for s in range(16)}
    for r in placed(docs):
        assert (r["shard"], r["grown_shard"]) == (chosen(r["doc_id"], even), chosen(r["doc_id"], even | {16: 1.0}))
    tree = {"a": {"a1": {0: 1.0, 1: 3.0}}, "b": {"b1": {2: 2.0}, "b2": {3: 0.5}}}
    for r in placed(docs, tree, tree):
        assert r["shard"] == chosen(r["doc_id"], {0: 1.0, 1: 3.0, 2: 2.0, 3: 0.5})


def test_keys_move_only_into_the_new_shard(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    rows = placed(docs)
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {16} and 0.8 < len(moved) / (20000 / 17) < 1.2
    assert all(0.85 < n / (20000 / 16) < 1.15 for n in Counter(r["shard"] for r in rows).values())


def test_a_heavier_shard_only_gains_and_shares_follow_weights(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    tree = {"a": {"a1": {0: 1.0, 1: 3.0}}, "b": {"b1": {2: 2.0}, "b2": {3: 2.0}}}
    heavier = {"a": {"a1": {0: 1.0, 1: 3.0}}, "b": {"b1": {2: 4.0}, "b2": {3: 2.0}}}
    rows = placed(docs, tree, heavier)
    assert {r["grown_shard"] for r in rows if r["shard"] != r["grown_shard"]} == {2}
    share = Counter(r["shard"] for r in rows)
    assert all(abs(share[s] / 20000 - w / 8) < 0.02 for s, w in ((0, 1), (1, 3), (2, 2), (3, 2)))


def test_odd_rows(odd_docs, no_docs):
    rows = placed(odd_docs)
    assert len(rows) == odd_docs.count() and all(r["shard"] in range(16) for r in rows)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (2, 3)} == {(1, 0)}
    assert len({r["shard"] for r in rows if r["doc_id"] == 8}) == 1 and len({r["slot"] for r in rows if r["doc_id"] == 8}) == 2
    assert placed(no_docs) == []
