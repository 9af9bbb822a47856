import hashlib
import math
import random

import numpy as np
import pytest

from indicatrix.llm import simplex_clusters as sc

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, v string, number long"


def brute(rows, rounds=10):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) in plain Python."""
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:8]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    done = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, k, d in done if k == c) for c in range(len(centroids))]
    return sorted(((i, k, d, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in done), key=str)


def found(df):
    return sorted((tuple(r) for r in sc.cluster(df).collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "v", None) for i, e in rows], SCHEMA)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = found(table)
    assert got == brute([(r["vec_id"], r["embedding"]) for r in table.collect()]) and len({r[1] for r in got}) == 8


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(64)]) for i in range(40)]
    rows += [rows[3], rows[3], (4, rows[5][1]), (None, rows[6][1]), (None, None), (50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [None] + [0.0] * 63),
             (55, [float("nan")] * 64), (56, [float("inf")] + [0.0] * 63), (2**62, [-0.0004] * 64), (-(2**62), [0.0] * 64)]
    assert found(made(spark, rows)) == brute(rows)


@pytest.mark.parametrize("rows", [
    [], [(7, None)], [(1, [0.5] * 64)], [(k, [0.25] * 64) for k in range(30)], [(k, [float(k)] * 64) for k in range(5)],
    [(k, [float(k % 2)] + [0.0] * 63) for k in range(20)], [(k, [float(k)] + [0.0] * 63) for k in range(40)]], ids=["none", "null", "one", "equal", "few", "two places", "a line"])
def test_few_and_tied(spark, rows):
    """Equal vectors, ties between centroids, centroids that lose all vectors, and pivots that span no simplex."""
    assert found(made(spark, rows)) == brute(rows)


def test_too_large(spark):
    with pytest.raises(Exception, match="64 bits"):
        sc.cluster(made(spark, [(1, [131073.0] * 64)]))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (8, 64))
    vectors = np.concatenate([c + rng.integers(-200, 200, (300, 64)) for c in centres])
    base = sc.simplex_base(np.concatenate([centres, vectors[::300]]))
    points, ends = sc.apexes(vectors, base), sc.apexes(centres, base)
    true = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centres], axis=1)
    flat = ((points[:, None, :-1] - ends[None, :, :-1]) ** 2).sum(axis=2)
    assert (flat + (points[:, None, -1] - ends[None, :, -1]) ** 2 <= true * (1 + 1e-9) + 1).all()
    assert (flat + (points[:, None, -1] + ends[None, :, -1]) ** 2 >= true * (1 - 1e-9) - 1).all()
    open_ = sc.candidates(points, ends)
    assert open_[np.arange(len(true)), true.argmin(axis=1)].all() and open_.mean() < 0.5


def test_a_pivot_in_the_span_of_others_is_left_out():
    points = np.array([[0, 0, 0], [10, 0, 0], [20, 0, 0], [0, 10, 0], [10, 0, 0]])
    assert sc.simplex_base(points).pivots.tolist() == [[0, 0, 0], [10, 0, 0], [0, 10, 0]]
