"""Embedding whitening with distributed block matrices.

Entries become integers x = floor(256 c). The fit list holds each distinct x once: n vectors with sums S. Its centred rows are
dealt into the blocks of a BlockMatrix A; A' A is the scatter. The d x d covariance is decomposed on the driver by ``eigh``, and the
rows are projected by a second multiplication with the whitening matrix W (eigenvectors over square roots of eigenvalues).

BlockMatrix sends all blocks of a middle index class to one task, and a tall matrix has one result block, so the multiplications split their
middle dimension: A' A has one middle index a block; for the projection the rows are dealt over ``lanes`` block columns, each with a
copy of W of its own. A task then holds a few blocks of ``CELLS`` entries, whatever the table's size.

Blocks are packed from a stored table and numbered by (place in the partition, partition), so a lost task packs the same block again; the last block of
a partition is filled with rows of zeros, which add nothing to the scatter and are left out of the result.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are those with an entry of more than
``LIMIT`` once scaled, and those whose length is not the commonest one (of equally common ones the greater); null and repeated vec_ids are
projected like others; repeated vectors count once in the fit; a component of no variance has a null ``whitened`` and an
``explained`` of 0; ``deviation`` is null if it exceeds a long; fewer than 4 dimensions give as many components; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.clusters import scaled
from cohortlab.llm.common import discard, lists, map_arrow, stored

SCALE, COMPONENTS = 256, 4
#: Largest entry once scaled.
LIMIT = (1 << 31) - 1
#: Entries of a block (1 MB of doubles), and blocks that one task of a multiplication holds, about.
CELLS, HELD = 1 << 17, 8
#: Eigenvalues below this share of the largest are rounding of zero.
NOTHING = 1e-12

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ------------------------------------------------------------------ integers, blocks


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x of the rows whose vector is whole."""

    def run(batch: pa.RecordBatch):
        rows, sizes, flat = scaled(batch.column(1), SCALE, LIMIT)
        yield pa.record_batch([batch.column(0).take(pa.array(rows)), lists(flat, sizes, pa.int32())], ["vec_id", "x"])

    return map_arrow(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "vec_id long, x array<int>").where("size(x) > 0")


def dimension(vectors: DataFrame) -> int:
    """The commonest length, of equally common ones the greater; 0 if there is no vector."""
    first = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def height(d: int) -> int:
    """Rows of a block."""
    return max(1, CELLS // d)


def packed(vectors: DataFrame, d: int) -> DataFrame:
    """block, ids, data (rows x d integers, 4 bytes each): the vectors in blocks of ``height(d)`` rows, stored."""
    tasks, rows = vectors.rdd.getNumPartitions(), height(d)

    def run(batches: Iterator[pa.RecordBatch]):
        at, ids, held, size = TaskContext.get().partitionId(), [], [], 0

        def block(ids, x):
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes()], pa.binary())], ["block", "ids", "data"])

        for batch in batches:
            held.append(batch.column(1).flatten().to_numpy().reshape(-1, d))
            ids.append(batch.column(0))
            size += len(held[-1])
            while size >= rows:
                x, all_ids = np.concatenate(held), pa.concat_arrays(ids)
                yield block(all_ids[:rows], x[:rows])
                at, ids, held, size = at + tasks, [all_ids[rows:]], [x[rows:]], size - rows
        if size:
            yield block(pa.concat_arrays(ids), np.concatenate(held))

    return stored(vectors.mapInArrow(run, "block long, ids array<long>, data binary"), "blocks")


def fitted_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sums per dimension)."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, total = 0, np.zeros(d, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0):
                x = np.frombuffer(data.as_py(), dtype="<i4").reshape(-1, d)
                n, total = n + len(x), total + x.sum(axis=0, dtype=np.int64)
        yield pa.record_batch([pa.array(np.arange(d + 1)), pa.array(np.append(total, n))], ["place", "value"])

    rows = blocks.select("data").mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    value = {r["place"]: int(r["value"]) for r in rows}  # d + 1 numbers
    return value.get(d, 0), [value.get(i, 0) for i in range(d)]


# ------------------------------------------------------------------ block matrices


def matrix(blocks: DataFrame, n: int, sums: list[int], lanes: int) -> BlockMatrix:
    """The centred rows, block i in block column i mod ``lanes``; kept on executors' disks, as a multiplication reads them twice."""
    d, rows = len(sums), height(len(sums))
    mean = [s / n for s in sums]

    def centred(row):
        x = np.zeros((rows, d))
        whole = np.frombuffer(row["data"], dtype="<i4").reshape(-1, d)
        x[: len(whole)] = whole - np.array(mean)
        return (row["block"], row["block"] % lanes), DenseMatrix(rows, d, x.ravel(order="F"))

    top = blocks.agg(F.max("block")).first()[0]
    made = BlockMatrix(blocks.select("block", "data").rdd.map(centred), rows, d, (top + 1) * rows, lanes * d)
    return made.persist(StorageLevel.DISK_ONLY)


def release(m: BlockMatrix) -> None:
    """Drop the kept blocks of ``m``."""
    m._java_matrix_wrapper._java_model.blocks().unpersist(False)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right with the middle dimension dealt over ``splits`` classes (PySpark's ``multiply`` lacks this argument of Scala's)."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def spectrum(blocks: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the covariance of the rows, by falling eigenvalue."""
    a = matrix(blocks, n, sums, 1)
    scatter = product(a.transpose(), a, math.ceil(blocks.count() / HELD)).toLocalMatrix().toArray()
    release(a)
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    return values[::-1], vectors[:, ::-1]


def projected(blocks: DataFrame, n: int, sums: list[int], w: np.ndarray) -> DataFrame:
    """block, z (as many arrays as a block has rows) of the rows times ``w``, stored."""
    spark, (d, c) = blocks.sparkSession, w.shape
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(blocks.count() / HELD))
    # the result's rows are dealt over the square root of the blocks' partitions; the lanes do the rest
    lanes = math.ceil(tasks / math.sqrt(blocks.rdd.getNumPartitions()))
    a = matrix(blocks, n, sums, lanes)
    copies = spark.sparkContext.parallelize(range(lanes), min(lanes, spark.sparkContext.defaultParallelism)).map(lambda lane: ((lane, 0), DenseMatrix(d, c, w.ravel(order="F"))))
    made = product(a, BlockMatrix(copies, d, c, lanes * d, c), lanes).blocks.map(lambda b: (b[0][0], b[1].toArray().tolist()))
    out = stored(spark.createDataFrame(made, "block long, z array<array<double>>"), "projected")
    release(a)
    return out


# ------------------------------------------------------------------ operator


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum over dimensions of (n x - S)^2 of each row, in whole numbers of any size."""
    far = np.abs(x).max(initial=0)
    if n * float(far) + max(map(abs, sums)) < math.sqrt((1 << 62) / len(sums)):
        gap = n * x.astype(np.int64) - np.array(sums, dtype=np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = x.astype(object) * n - np.array(sums, dtype=object)
    return [int(v) if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)]


def whitened(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that counts and component up to 4."""
    spark = embeddings.sparkSession
    every = stored(integer_vectors(embeddings), "vectors")
    d = dimension(every)
    if d == 0:
        return spark.createDataFrame([], SCHEMA)
    alike = every.where(F.size("x") == d)
    distinct = stored(alike.select("x").distinct(), "distinct")
    fit = packed(distinct.select(F.lit(None).cast("long").alias("vec_id"), "x"), d)
    n, sums = fitted_sums(fit, d)
    values, vectors = spectrum(fit, n, sums)
    count = min(COMPONENTS, d)
    real = [c for c in range(count) if values[c] > max(NOTHING * values[0], 0)]
    w = np.zeros((d, count))
    for c in real:
        w[:, c] = vectors[:, c] / math.sqrt(values[c])
    error = identity_error(projected(fit, n, sums, w), n, real)
    explained = [float(values[c] / values.sum()) if c in real else 0.0 for c in range(count)]
    discard(distinct, fit)
    return rows_of(packed(alike, d), n, sums, w, real, explained, error)


def identity_error(fit: DataFrame, n: int, real: list[int]) -> float | None:
    """Largest entry of the covariance of the fit list's whitened rows less the identity."""
    if not real:
        return None
    rows = fit.select(F.explode("z").alias("z"))  # rows of zeros, which fill blocks up, add nothing
    pairs = [(a, b) for a in real for b in real if a <= b]
    sums = rows.agg(*[F.sum(F.col("z")[a]).alias(f"s{a}") for a in real], *[F.sum(F.col("z")[a] * F.col("z")[b]).alias(f"p{a}_{b}") for a, b in pairs]).first()
    return max(abs(sums[f"p{a}_{b}"] / n - sums[f"s{a}"] / n * sums[f"s{b}"] / n - (a == b)) for a, b in pairs)


def rows_of(blocks: DataFrame, n: int, sums: list[int], w: np.ndarray, real: list[int], explained: list[float], error: float | None) -> DataFrame:
    """The result: each block's ids and deviations beside its projections."""
    d, count = w.shape

    def measured(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(2)[i].as_py(), dtype="<i4").reshape(-1, d)
            yield pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([deviations(x, n, sums)], pa.list_(pa.int64()))], ["block", "ids", "deviations"])

    kept = map_arrow(blocks.select("block", "ids", "data"), measured, "block long, ids array<long>, deviations array<long>")
    both = kept.join(projected(blocks, n, sums, w), "block").withColumn("z", F.slice("z", F.lit(1), F.size("ids")))  # without the rows that fill a block up
    both = both.select(F.explode(F.arrays_zip("ids", "deviations", "z")).alias("r"))
    parts = F.array(*[F.struct(F.lit(c + 1).alias("component"), (F.col("r.z")[c] if c in real else F.lit(None).cast("double")).alias("whitened"),
                               F.lit(explained[c]).alias("explained")) for c in range(count)])
    return both.select(F.col("r.ids").alias("vec_id"), F.col("r.deviations").alias("deviation"), F.explode(parts).alias("p")).select(
        "vec_id", "p.component", F.lit(n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(error).cast("double").alias("identity_error"))
