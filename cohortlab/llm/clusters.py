"""Centroid clustering of embeddings by a bisector tournament.

For two centroids a < b the points nearer to b lie on one side of a hyperplane: 2 (b - a) . x > |b|^2 - |a|^2. The integer
normals and thresholds of all pairs are worked out once a round. A vector meets the centroids in order; each of the k - 1 sign tests
drops the loser, and zero, a tie, keeps the smaller number. Only the distance to the winner is worked out, exactly.

Components are integers, floor(64 c), so tests, sums and distances are exact and do not depend on the order of rows. Each task adds up
its vectors per cluster; Spark adds the tasks' rows. The driver sees k x 64 sums and the k starting vectors.

Defined cases: a vector that is null, has not exactly 64 components, or holds a null or non-finite one is dropped, and so is one with a component
of more than ``LIMIT`` once scaled, whose distances would not fit a long; each repeated row counts; a row with a null vec_id is clustered but never
a starting centroid; rows of one vec_id start in the order of their vectors; with fewer than k vectors there are as many centroids;
an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import discard, lists, map_arrow, stored

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Largest component: 64 squared differences of twice that fit a long.
LIMIT = 1 << 27


def scaled(vectors: pa.Array, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows whose vector is whole, their lengths, their floor(scale * c) one after the other) of a list column."""
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # leaves out the null lists
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(values * scale)
        bad = ~(np.abs(whole) <= limit)
    row = np.repeat(np.arange(len(sizes)), np.where(valid, sizes, 0))
    good = valid.copy()
    good[row[bad]] = False
    rows = np.flatnonzero(good)
    return rows, sizes[rows], whole[good[row]].astype(np.int64)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (64 integers) of the vectors that count."""

    def run(batch: pa.RecordBatch):
        rows, sizes, flat = scaled(batch.column(1), SCALE, LIMIT)
        fit = sizes == DIMENSIONS
        flat = flat[np.repeat(fit, sizes)]
        yield pa.record_batch([batch.column(0).take(pa.array(rows[fit])), lists(flat, sizes[fit], pa.int32())], ["vec_id", "x"])

    return map_arrow(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "vec_id long, x array<int>")


def starting_centroids(vectors: DataFrame) -> np.ndarray:
    """The vectors of the k smallest hashes of ``1:<vec_id>``."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id IS NOT NULL").select(order.alias("h"), "x").orderBy("h", "x").limit(CENTROIDS).collect()
    if not first:  # no vector has an id: the smallest vectors start
        first = vectors.select("x").orderBy("x").limit(CENTROIDS).collect()
    return np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, DIMENSIONS)


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals [a, b] and thresholds [a, b]: x is nearer to b than to a if normal . x > threshold."""
    square = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), square[None, :] - square[:, None]


def winners(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row: the champion so far, the smaller number, meets the next one."""
    champion = np.zeros(len(x), dtype=np.int64)
    for rival in range(1, len(thresholds)):
        # the rows of one champion share a bisector
        for c in np.unique(champion):
            own = np.flatnonzero(champion == c)
            champion[own[x[own] @ normals[c, rival] > thresholds[c, rival]]] = rival
    return champion


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().astype(np.int64).reshape(-1, DIMENSIONS)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the clusters' exact means; an empty cluster keeps its centroid."""
    plain, k = centroids.tolist(), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]):
        normals, thresholds = bisectors(np.array(plain, dtype=np.int64))
        sums, counts = np.zeros((k, DIMENSIONS), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch, 0)
            own = winners(x, normals, thresholds)
            counts += np.bincount(own, minlength=k)
            for c in np.unique(own):
                sums[c] += x[own == c].sum(axis=0)
        cells = np.concatenate([sums, counts[:, None]], axis=1)[counts > 0]
        cluster = np.repeat(np.flatnonzero(counts), DIMENSIONS + 1)
        yield pa.record_batch([pa.array(cluster), pa.array(np.tile(np.arange(DIMENSIONS + 1), len(cells))), pa.array(cells.ravel())], ["cluster", "place", "value"])

    part = vectors.select("x").mapInArrow(run, "cluster long, place long, value long")
    rows = part.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # k x 65 at most
    total = {(r["cluster"], r["place"]): int(r["value"]) for r in rows}
    out = centroids.copy()
    for c in range(k):
        if n := total.get((c, DIMENSIONS)):
            out[c] = [total[c, d] // n for d in range(DIMENSIONS)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared, exact)."""
    plain = centroids.tolist()

    def run(batch: pa.RecordBatch):
        own_centroids = np.array(plain, dtype=np.int64)
        x = _matrix(batch, 1)
        own = winners(x, *bisectors(own_centroids))
        gap = x - own_centroids[own]
        yield pa.record_batch([batch.column(0), pa.array(own.astype(np.int32)), pa.array((gap * gap).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return map_arrow(vectors.select("vec_id", "x"), run, "vec_id long, cluster int, distance long")


def clustered(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia of every vector that counts; the final centroids)."""
    vectors = stored(integer_vectors(embeddings), "vectors")
    centroids = starting_centroids(vectors)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    if not len(centroids):
        out = vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")])
        return out, centroids
    out = stored(assigned(vectors, centroids), "assigned")
    discard(vectors)
    rows = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    by = {r["cluster"]: int(r["inertia"]) for r in rows}
    fit = lambda n: n if n < 1 << 63 else None  # noqa: E731  (null once a sum exceeds a long)
    return out.select("vec_id", "cluster", "distance", of_cluster({c: fit(n) for c, n in by.items()}).cast("long").alias("cluster_inertia"),
                      F.lit(fit(sum(by.values()))).cast("long").alias("inertia")), centroids


def of_cluster(values: dict) -> Column:
    """The value of the row's cluster."""
    out = F.lit(None)
    for c, v in values.items():
        out = F.when(F.col("cluster") == c, F.lit(v)).otherwise(out)
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def with_digest(out: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds centroid_sha256 of each row's final centroid."""
    digests = {c: centroid_digest(x) for c, x in enumerate(centroids)}
    return out.withColumn("centroid_sha256", of_cluster(digests).cast("string"))
