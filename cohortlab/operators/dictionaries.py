"""Ordered dictionaries of string values at any cardinality.

The distinct (feature, value) rows are range-partitioned and stored with the number of their
range; a range is numbered by its own window, and the rows of earlier ranges, counted per range
and feature, are added. Neither a task nor the driver holds a feature's values.
"""
from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.operators.prefix import default_blocks
from cohortlab.session import materialize

#: What a null category becomes before encoding.
MISSING = "missing"
#: The code of a value that the dictionary does not hold.
UNKNOWN = -1


def filled(col: str) -> Column:
    """L3: a null category is a category of its own."""
    return F.coalesce(F.col(col).cast("string"), F.lit(MISSING))


def long_values(df: DataFrame, cols: list[str], value=F.col) -> DataFrame:
    """(feature, value), one row per row and column; ``value`` maps a column name to its expression."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), value(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(each))


def ordered_values(long: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """(feature, value, ord): distinct non-null values, numbered from 1 within their feature in binary order."""
    n_blocks = n_blocks or default_blocks(long.sparkSession)
    distinct = long.where(F.col("value").isNotNull()).select("feature", "value").distinct()
    ranged = materialize(distinct.repartitionByRange(n_blocks, "feature", "value").withColumn("_blk", F.spark_partition_id()), "dictionary-ranges")
    counts = ranged.groupBy("feature", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("feature").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    # ranges are contiguous: at most n_blocks + features - 1 rows, whatever the number of values
    offsets = counts.select("feature", "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy("feature", "_blk").orderBy("value"))
    return ranged.join(offsets, ["feature", "_blk"]).select("feature", "value", (own + F.col("_off")).alias("ord"))


class Dictionary(Transformer):
    """L5 + J7: alphabetical codes from 0 per column; a null is the category 'missing', an unseen value -1.

    The codes are a stored table and are joined: a column at a time, by value, so a small dictionary is broadcast by its size,
    and a large one shuffles with AQE splitting hot values.
    """

    def __init__(self, codes: DataFrame, cols: list[str], suffix: str = "__o"):
        super().__init__()
        self.codes, self.cols, self.suffix = codes, list(cols), suffix

    @classmethod
    def fit(cls, train: DataFrame, cols: list[str], suffix: str = "__o", n_blocks: int | None = None) -> Dictionary:
        ordered = ordered_values(long_values(train, cols, filled), n_blocks)
        codes = ordered.select("feature", "value", (F.col("ord") - 1).cast("double").alias("code"))
        return cls(materialize(codes, "dictionary"), cols, suffix)

    def sizes(self) -> list[int]:
        """Number of known values per column."""
        n = {r["feature"]: r["n"] for r in self.codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
        return [n.get(c, 0) for c in self.cols]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for i, c in enumerate(self.cols):
            own = self.codes.where(F.col("feature") == c).select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
            dataset = dataset.join(own, filled(c) == F.col(f"_value{i}"), "left").withColumn(
                f"{c}{self.suffix}", F.coalesce(F.col(f"_code{i}"), F.lit(float(UNKNOWN)))).drop(f"_value{i}", f"_code{i}")
        return dataset
