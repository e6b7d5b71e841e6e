"""Readers and writers: parquet tables, raw CSV, eval questions, corpus files."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab import constants as C

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in C.RAW_COLUMNS])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S3: one driver table (parquet); column pruning / filter pushdown reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw company CSV, every column a string, header checked against the contract.

    The header check only touches the first line's metadata (Spark reads the header
    per file); the data itself is never inferred.
    """
    header_df = spark.read.option("header", True).csv(path)
    missing = sorted(set(C.RAW_COLUMNS) - set(header_df.columns))
    if missing:
        raise ValueError(f"raw CSV is missing expected columns: {missing}")
    df = spark.read.option("header", True).option("enforceSchema", False).schema(
        T.StructType([T.StructField(c, T.StringType(), True) for c in header_df.columns])
    ).csv(path)
    return df.select(*C.RAW_COLUMNS)


def write_features(df: DataFrame, out_dir: str, version: str = "v1") -> str:
    """Versioned feature parquet, partitioned by split so each side prunes."""
    path = os.path.join(out_dir, f"features_{version}")
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


EVAL_SCHEMA = T.StructType([
    T.StructField("question", T.StringType(), True),
    T.StructField("expected_chunk_ids", T.ArrayType(T.StringType()), True),
])


def read_eval_questions(spark: SparkSession, path: str) -> DataFrame:
    """Eval questions JSON (an array of objects) with an explicit schema."""
    return spark.read.option("multiLine", True).schema(EVAL_SCHEMA).json(path)


def write_eval_questions(questions: DataFrame, path: str, per_file: int = 1000) -> str:
    """Files of one JSON array each, which ``read_eval_questions`` reads: about ``per_file`` questions, dealt by hash."""
    names = [f.name for f in EVAL_SCHEMA.fields]
    files = max(1, -(-questions.count() // per_file))
    # equal questions are numbered, so that they do not all go to one file, whichever task is run again
    counted = questions.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select(*names, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    dealt = counted.select(*names, F.pmod(F.xxhash64(*names, "_i"), F.lit(files)).alias("_file"))
    arrays = dealt.groupBy("_file").agg(F.to_json(F.collect_list(F.struct(*names))).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


def read_markdown_corpus(spark: SparkSession, folder: str, pattern: str = "*.md", by_folder: bool = False) -> DataFrame:
    """One row per Markdown file: (doc_id = file stem, or with ``by_folder`` the file's folder, text)."""
    df = spark.read.text(os.path.join(folder, pattern), wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if by_folder else F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    return df.select(name.alias("doc_id"), F.col("value").alias("text"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Generic parquet sink (S6/S7/S8 use it for index, ECDF and registry tables)."""
    df.write.mode(mode).parquet(path)
    return path


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin repartition when a scan yields fewer splits than the cluster has cores.

    CPU-heavy per-row work (chunking, tokenising) right after a scan of a few large
    row groups would otherwise run in one task. On a cluster reading many files the
    scan already has more splits than cores and this is a no-op (no extra shuffle).
    """
    target = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
