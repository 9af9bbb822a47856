"""Exact integer k-means in which n-simplex projections decide which centroids a vector is compared with.

A vector's exact distances to a few pivots, taken once and kept, fix the apex of a simplex over the pivots: coordinates in the space that the pivots span, and the
height above it. The distance of two apexes on the same side is a lower bound of the vectors' distance, on opposite sides an upper bound. Per round, a
centroid whose lower bound lies above another one's upper bound is out; the rest are compared by exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import Scratch

DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: Vectors whose distances are kept; the first ones are also the first centroids.
PIVOTS = 16
#: Where more than this share of centroids stays open in a round, the centroids become the pivots, and distances to them are kept from then on.
OPEN_SHARE = 0.5
#: Integers up to this size have squared distances of 64 bits: 64 * (2 * 2^27)^2 = 2^62.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Base:
    """Pivots, and the triangle that turns distances to them into apex coordinates."""

    pivots: np.ndarray
    sides: np.ndarray
    triangle: np.ndarray


def _squares(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    return ((vectors - point) ** 2).sum(axis=-1)


def simplex_base(candidates: np.ndarray) -> Base:
    """The candidates that span a simplex: one that lies in the span of those before, or near it, is left out."""
    chosen, rows = [candidates[0]], np.zeros((0, 0))
    scale = max(float(_squares(candidates, candidates[0]).max()), 1.0)
    for point in candidates[1:]:
        differences = np.array([p - chosen[0] for p in chosen[1:]], float).reshape(-1, candidates.shape[1])
        step = (point - chosen[0]).astype(float)
        along = np.linalg.solve(rows, differences @ step) if len(rows) else np.zeros(0)
        height = float(step @ step - along @ along)
        if height > 1e-3 * scale:
            rows = np.block([[rows, np.zeros((len(rows), 1))], [along[None, :], np.array([[height**0.5]])]])
            chosen.append(point)
    pivots = np.array(chosen)
    return Base(pivots, _squares(pivots, pivots[0]), rows)


def apexes(vectors: np.ndarray, base: Base) -> np.ndarray:
    """Apex coordinates from the distances to the pivots; the last one is the height, never negative."""
    squares = np.stack([_squares(vectors, p) for p in base.pivots], axis=1)
    products = (squares[:, :1] + base.sides[None, 1:] - squares[:, 1:]) / 2
    flat = np.linalg.solve(base.triangle, products.T).T if len(base.triangle) else np.zeros((len(vectors), 0))
    height = np.sqrt(np.maximum(squares[:, 0] - (flat * flat).sum(axis=1), 0))
    return np.concatenate([flat, height[:, None]], axis=1)


def candidates(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For every point and centre, both as apexes, whether the centre may be the nearest one. Bounds give way by more than their rounding."""
    lower, upper = np.empty((len(points), len(centres))), np.empty((len(points), len(centres)))
    size = (points * points).sum(axis=1)
    for k, centre in enumerate(centres):
        flat = ((points[:, :-1] - centre[:-1]) ** 2).sum(axis=1)
        slack = 1e-7 * (size + centre @ centre) + 1
        lower[:, k] = flat + (points[:, -1] - centre[-1]) ** 2 - slack
        upper[:, k] = flat + (points[:, -1] + centre[-1]) ** 2 + slack
    return lower <= upper.min(axis=1, keepdims=True)


def nearest(vectors: np.ndarray, points: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every vector (ties: the smaller number), the squared distance, in integers, and how many distances were taken."""
    open_ = candidates(points, centres)
    best, cluster = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for k in range(len(centroids)):
        rows = np.flatnonzero(open_[:, k])
        distance = _squares(vectors[rows], centroids[k])
        closer = distance < best[rows]
        best[rows[closer]], cluster[rows[closer]] = distance[closer], k
    return cluster, best, int(open_.sum())


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the integers floor(1024 * x), of the rows with exactly 64 components, none null or non-finite."""
    values = F.transform(embeddings["embedding"], lambda x: x.cast("double"))
    sound = (F.size("x") == DIMENSIONS) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall("x", lambda x: F.abs(x) * SCALE < LARGEST)
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), values.alias("x")).where(F.coalesce(sound, F.lit(False)))
    v = F.when(fits, F.transform("x", lambda x: F.floor(x * SCALE).cast("int"))).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} has no squared distance of 64 bits")))
    return rows.select("vec_id", v.alias("v"))


def _with_apexes(vectors: DataFrame, base: Base) -> DataFrame:
    width = len(base.pivots)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = apexes(_matrix(batch.column("v"), DIMENSIONS, np.int64), base)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * width), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), column], names=["vec_id", "v", "apex"])

    return vectors.mapInArrow(projected, "vec_id long, v array<int>, apex array<double>")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, base: Base) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    centres = apexes(centroids, base)
    for batch in batches:
        vectors = _matrix(batch.column("v"), DIMENSIONS, np.int64)
        yield batch, vectors, *nearest(vectors, _matrix(batch.column("apex"), len(base.pivots), float), centroids, centres)


def moved(rows: DataFrame, centroids: np.ndarray, base: Base) -> tuple[np.ndarray, float]:
    """Every centroid at the exact floor of its vectors' mean; one without vectors stays. Also the share of distances that were taken.

    A task sends one row for each centroid and component.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, taken = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64), 0
        for _, vectors, cluster, _, compared in _assigned(batches, centroids, base):
            taken += compared
            for k in range(len(centroids)):
                total[k] += vectors[cluster == k].sum(axis=0)
            n += np.bincount(cluster, minlength=len(centroids))
        k, d = np.indices(centroids.shape).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (k, d, total, np.repeat(n[:, None], DIMENSIONS, axis=1), np.full(k.shape, taken))], names=["k", "d", "total", "n", "taken"])

    added = rows.mapInArrow(sums, "k int, d int, total long, n long, taken long").groupBy("k", "d") \
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.sum("taken").alias("taken")).collect()  # at most 8 * 64 rows
    out = centroids.copy()
    for r in added:
        if r["n"]:
            out[r["k"], r["d"]] = int(r["total"]) // r["n"]
    everything = sum(r["n"] for r in added if r["d"] == 0) * len(centroids)
    return out, added[0]["taken"] / everything if everything else 0.0


def _hash(vec_id) -> F.Column:
    return F.sha2(F.concat(F.lit("3:"), vec_id.cast("string")), 256)


def cluster(embeddings: DataFrame, rounds: int = ROUNDS, k: int = CENTROIDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that has 64 finite components; other rows are left out.

    The first centroids are the vectors with the smallest hashes of their ids. Rows of one id, or equal vectors, are vectors each; of rows with one id the one with the smaller
    components comes first. A null id is clustered like any other and starts no centroid while there are others. Fewer vectors than centroids: as many centroids as
    vectors. No vectors: no rows. A component beyond 2^27 after scaling is an error, as its distances have no 64 bits; an inertia beyond 64 bits is null.
    Other columns stay behind. The driver holds the centroids and pivots, nothing that grows with the rows.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "clusters")
    vectors = integer_vectors(embeddings)
    first = [r["v"] for r in vectors.orderBy(_hash(F.col("vec_id")).asc_nulls_last(), "v").limit(max(PIVOTS, k)).collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    first = np.array(first, np.int64)
    centroids, base = first[:k], simplex_base(first[:PIVOTS])
    rows, table = scratch.keep(_with_apexes(vectors, base), "apexes"), "apexes"
    for r in range(rounds):
        centroids, taken = moved(rows, centroids, base)
        if taken > OPEN_SHARE:
            base = simplex_base(centroids)
            rows = scratch.keep(_with_apexes(rows, base), f"apexes-{r}")
            scratch.drop(table)
            table = f"apexes-{r}"

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, distance, _ in _assigned(batches, centroids, base):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    done = scratch.keep(rows.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned")
    scratch.drop(table)
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    return done.join(F.broadcast(spark.createDataFrame(_summary(inertia, centroids), "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster") \
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _summary(inertia: dict[int, int], centroids: Sequence[Sequence[int]]) -> list[tuple]:
    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    return [(k, fits(inertia.get(k, 0)), fits(sum(inertia.values())), hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for k, c in enumerate(centroids)]


def oracle_sql(rounds: int = ROUNDS, k: int = CENTROIDS) -> str:
    """The same clustering in DuckDB: one step a round, without pivots."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(number, (d, number)) AS number, min(d) AS d FROM (
            SELECT n.vec_id, n.v, c.number, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (n.v[i] - c.v[i]) * (n.v[i] - c.v[i])))::BIGINT AS d, n.row FROM numbered n, c{r} c) GROUP BY row, vec_id, v)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.number, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
                SELECT number, list(floor_mean ORDER BY i) AS v FROM (
                    SELECT number, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS floor_mean FROM (
                        SELECT number, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY number, i)) GROUP BY number) m ON m.number = c.number)""")
    return f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        numbered AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x::HUGEINT) AS v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) AS row FROM kept),
        c0 AS MATERIALIZED (SELECT (row - 1)::INTEGER AS number, v FROM numbered WHERE row <= {k}),
        {', '.join(steps)}
        SELECT a.vec_id, a.number AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.number))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.number = a.number"""
