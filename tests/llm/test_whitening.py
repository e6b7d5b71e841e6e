"""Whitening against numpy over the whole matrix."""
import math
import random

import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def check(df):
    out = whitening.whitened(df)
    got = out.collect()
    assert out.columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and max(abs(math.floor(256 * c)) for c in v) <= whitening.LIMIT]
    sizes = [len(x) for _, x in kept]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    assert len(got) == len(kept) * min(4, d)
    if not n:
        return got
    sums = [sum(col) for col in zip(*fit)]
    centred = np.array(fit, dtype=float) - np.array(sums, dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = [c for c in range(min(4, d)) if values[c] > 1e-12 * max(values[0], 0) and values[c] > 0]
    assert all(r["n"] == n and (r["identity_error"] <= 1e-4 if real else r["identity_error"] is None) for r in got)
    for c in range(min(4, d)):
        own = [r for r in got if r["component"] == c + 1]
        want = sorted(((i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), tuple(x)) for i, x in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        mine = sorted(own, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"] if r["deviation"] is not None else math.inf))
        assert [(r["vec_id"], r["deviation"]) for r in mine] == [(i, dev if dev < 1 << 63 else None) for i, dev, _ in want]
        if c not in real:
            assert all(r["whitened"] is None and r["explained"] == 0 for r in own)
            continue
        z = np.array([(np.array(x) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c]) for _, _, x in want])
        w = np.array([r["whitened"] for r in mine])
        assert min(np.abs(z - w).max(), np.abs(z + w).max()) < 1e-8
        assert all(abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-6 for r in own)
    return got


def test_whitening_of_the_table(spark, sf):
    assert len(check(spark.read.parquet(f"{sf}/embeddings.parquet"))) > 400


def test_many_blocks_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CELLS", 40)
    monkeypatch.setattr(whitening, "HELD", 2)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, s) for s in (3, 2, 1, 0.5, 0.2)]) for i in range(400)]
    check(spark.createDataFrame(rows + rows[:150], SCHEMA).repartition(5))


def test_odd_vectors(spark):
    rng = random.Random(2)
    some = lambda n=6: [rng.uniform(-1, 1) * (k + 1) for k in range(n)]
    copy = some()
    rows = [(i, some()) for i in range(40)] + [(100 + i, copy) for i in range(30)] + [(7, some()), (7, copy), (None, some()), (None, None), (50, None), (51, []), (52, some(5)), (53, some(7)),
            (54, some(5) + [None]), (55, some(5) + [float("nan")]), (56, some(5) + [float("inf")]), (57, some(5) + [1e30]), (58, [-0.0] * 6), (59, [0.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("component", "x", "z", "block", "ids", "data", "label")])
    check(df)
    check(df.where("vec_id >= 100"))  # one distinct vector: no variance
    check(df.where("vec_id IN (1, 2, 3)"))  # rank 2
    assert check(df.limit(0)) == [] and check(df.where("vec_id IN (50, 51, 54, 55, 56, 57)")) == []
    check(spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(20)], SCHEMA))  # two dimensions
    check(spark.createDataFrame([(i, [rng.choice([-1, 1]) * 2.0**22, rng.uniform(-1, 1) * 2.0**22]) for i in range(300)], SCHEMA))  # deviations beyond a long
