"""Helpers shared by the operators: tables, stored intermediates, array columns.

Every intermediate that is read more than once is written as Parquet below the shared folder that
``spark.checkpoint.dir`` names, so a lost executor loses no data and no lineage is replayed.
"""
from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import ensure_checkpoint_dir

#: Word separators of the whitespace-delimited operators: space and code points 9 to 13.
SEPARATORS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks for the steps that read it again; what is lost is computed anew."""
    return df.persist(StorageLevel.DISK_ONLY)


def compact(df: DataFrame) -> DataFrame:
    """At most two tasks a core: narrow results of one short row per document need no more files."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def merged(df: DataFrame) -> DataFrame:
    """A join's side that grows with the corpus: it is dealt out and merged, however small it is, as a broadcast would pass it through the driver whole."""
    return df.hint("merge")


def parts(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over at least the default parallelism; a table that already has as many splits stays."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= n else df.repartition(n)


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 4, equals 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def with_text_key(docs: DataFrame) -> DataFrame:
    """docs with ``tk``, which tells rows of one doc_id apart: the hash of the text where the id is null or several rows share it, else 0."""
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("again")), "again")
    own = F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    if again.isEmpty():
        return docs.withColumn("tk", F.when(F.col("doc_id").isNull(), own).otherwise(F.lit(0).cast("long")))
    told = docs.join(again, "doc_id", "left")
    return told.withColumn("tk", F.when(F.col("doc_id").isNull() | F.col("again"), own).otherwise(F.lit(0).cast("long"))).drop("again")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` yields record batches for each input batch."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def discard(*frames: DataFrame) -> None:
    """Delete stored intermediates that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
