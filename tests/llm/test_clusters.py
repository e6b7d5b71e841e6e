"""Centroid clustering against a brute-force version."""
import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import clusters

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, rounds=clusters.ROUNDS):
    """(vec_id, cluster, distance, cluster inertia, inertia) and centroids, in whole Python numbers."""
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v) and max(abs(math.floor(64 * c)) for c in v) <= clusters.LIMIT]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None) or sorted(("", x) for _, x in kept)
    centroids = [x for _, x in named[:16]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            if mine := [x for (_, x), o in zip(kept, own) if o == k]:
                centroids[k] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, k, d in last:
        inertia[k] += d
    return sorted(((i, k, d, inertia[k], sum(inertia.values())) for i, k, d in last), key=repr), centroids


def check(df):
    out, centroids = clusters.clustered(df)
    rows, want = plain([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    assert sorted((tuple(r) for r in out.collect()), key=repr) == rows
    assert centroids.tolist() == want
    for r in clusters.with_digest(out, centroids).limit(20).collect():
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want[r["cluster"]])).encode()).hexdigest()
    return rows


def test_clusters_of_the_table(spark, sf):
    assert len(check(spark.read.parquet(f"{sf}/embeddings.parquet"))) > 100


def test_bisectors_agree_with_distances():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-3, 4, (16, 64))
    centroids[5] = centroids[2]  # equal centroids: the smaller number
    x = np.concatenate([rng.integers(-3, 4, (500, 64)), centroids, (centroids[:8] + centroids[8:]) // 2])
    distance = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (clusters.winners(x, *clusters.bisectors(centroids)) == distance.argmin(axis=1)).all()


def test_odd_vectors(spark):
    rng = random.Random(2)
    some = lambda n=64: [rng.uniform(-1, 1) for _ in range(n)]
    copy = some()
    rows = [(i, some()) for i in range(40)] + [(100 + i, copy) for i in range(30)] + [(7, some()), (7, copy), (None, some()), (None, None), (50, None), (51, []), (52, some(63)), (53, some(65)),
            (54, some(63) + [None]), (55, some(63) + [float("nan")]), (56, some(63) + [float("inf")]), (57, some(63) + [1e30]), (58, [-0.0] * 64), (59, [0.0] * 64), (60, [2.0**20] * 64), (61, [-(2.0**20)] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("cluster", "distance", "x", "place", "value", "inertia", "label")])
    assert len(check(df)) == 40 + 30 + 3 + 4
    check(df.where("vec_id < 5"))  # fewer vectors than centroids
    check(df.where("vec_id IS NULL"))
    check(df.where("vec_id >= 100"))  # equal vectors, one cluster
    assert check(df.limit(0)) == [] and check(df.where("vec_id BETWEEN 50 AND 57")) == []
    check(df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).repartition(7))
