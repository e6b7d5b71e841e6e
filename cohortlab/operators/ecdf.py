"""A stored empirical distribution with a block index.

``store`` writes the distinct values with their counts at or below, in value order, a folder per block of
consecutive values, and one index row per block. A lookup finds each value's block by binary search in the index and
reads the folders of those blocks only, so a micro-batch costs its own blocks, not the reference rows.
"""
from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.operators.prefix import blocks_below, running_sums
from cohortlab.session import ensure_checkpoint_dir, materialize

#: Distinct values of a block, and the most blocks of an index: beyond their product blocks grow, not the index.
BLOCK_VALUES = 65_536
MAX_BLOCKS = 4_096


@dataclass(frozen=True)
class Ecdf:
    """A stored distribution: its folder, each block's largest value and the rows of all blocks before, and all rows."""
    path: str
    highs: tuple[float, ...]
    before: tuple[int, ...]
    total: int

    def cells(self, spark: SparkSession) -> DataFrame:
        """(score, n, cum_n, total, blk)."""
        return spark.read.schema("score double, n long, cum_n long, blk int").parquet(os.path.join(self.path, "cells")).withColumn("total", F.lit(self.total))

    def percentile(self, requests: DataFrame, col: str = "probability") -> DataFrame:
        """Adds ``n_at_or_below`` and ``percentile`` = 100 * share of reference values at or below the row's value.

        A null value, or any value where the reference is empty, has no percentile.
        """
        spark = requests.sparkSession
        values = requests.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull()).distinct()
        highs = F.array(*[F.lit(h) for h in self.highs]) if self.highs else F.array().cast("array<double>")
        one = spark.range(1).select(highs.alias("_highs"))  # one array of at most MAX_BLOCKS numbers
        at = values.crossJoin(F.broadcast(one)).select("_v", blocks_below(F.col("_highs"), F.col("_v"), len(self.highs)).alias("blk"))
        at = materialize(at, "ecdf-values")
        wanted = [r["blk"] for r in at.select("blk").distinct().collect()]  # at most MAX_BLOCKS + 1
        index = spark.createDataFrame([(b, n) for b, n in enumerate((*self.before, self.total))], "blk int, _before long")
        cells = self.cells(spark).where(F.col("blk").isin(wanted)).select("blk", F.col("score").alias("_v"), "cum_n", F.lit(0).alias("_kind"))
        both = cells.unionByName(at.select("blk", "_v", F.lit(None).cast("long").alias("cum_n"), F.lit(1).alias("_kind")))
        seen = Window.partitionBy("blk").orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("_n", F.last("cum_n", ignorenulls=True).over(seen)).where(F.col("_kind") == 1)
        counts = found.join(F.broadcast(index), "blk").select("_v", F.coalesce("_n", "_before").alias("n_at_or_below"))
        share = F.lit(100.0) * F.col("n_at_or_below") / F.nullif(F.lit(self.total), F.lit(0))
        return requests.join(counts, F.col(col).cast("double") == F.col("_v"), "left").drop("_v").withColumn("percentile", share)


def store(reference: DataFrame, score_col: str = "score", path: str | None = None, block_values: int = BLOCK_VALUES) -> Ecdf:
    """Write the distribution of the non-null values below ``path`` (default: the checkpoint folder)."""
    spark = reference.sparkSession
    path = path or os.path.join(ensure_checkpoint_dir(spark), f"ecdf-{uuid.uuid4().hex}")
    s = F.col(score_col).cast("double")
    counts = materialize(reference.where(s.isNotNull()).groupBy(s.alias("score")).agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1)), "ecdf-counts")
    size = max(block_values, -(-counts.count() // MAX_BLOCKS))
    cum = running_sums(counts, "score", ["n", "_one"]).select(
        "score", "n", F.col("cum_n").cast("long").alias("cum_n"), F.floor((F.col("cum__one") - 1) / size).cast("int").alias("blk"))
    (cum.repartition("blk").sortWithinPartitions("blk", "score").write.mode("overwrite").partitionBy("blk").parquet(os.path.join(path, "cells")))
    stored = spark.read.schema("score double, n long, cum_n long, blk int").parquet(os.path.join(path, "cells"))
    index = (stored.groupBy("blk").agg(F.max("score").alias("high"), F.min(F.col("cum_n") - F.col("n")).alias("before"), F.max("cum_n").alias("upto")))
    index.write.mode("overwrite").parquet(os.path.join(path, "blocks"))
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Ecdf:
    """The distribution that ``store`` wrote below ``path``; only the index is read."""
    rows = spark.read.parquet(os.path.join(path, "blocks")).orderBy("blk").collect()  # at most MAX_BLOCKS
    return Ecdf(path, tuple(r["high"] for r in rows), tuple(r["before"] for r in rows), max((r["upto"] for r in rows), default=0))
