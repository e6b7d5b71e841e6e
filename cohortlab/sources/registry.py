"""Model registry for reruns and concurrent writers.

A commit is a folder of parquet rows that is written aside and renamed into ``commits`` under a name of its own: run id, time,
unique id. A folder is there whole or not at all, writers never meet, and of several commits of one run (a
replay, a speculative twin) the first counts. Rename is atomic on HDFS and local disks; on an object store
``path`` needs a committer that makes it so.
"""
from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN_ID = re.compile(r"[A-Za-z0-9_-]+")
_COMMIT = re.compile(r"([A-Za-z0-9_-]+)\.(\d{13})\.([0-9a-f]{32})")


def _folder(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def _commits(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of the first commit of every run: one entry per run."""
    fs, p = _folder(spark, f"{path}/commits")
    first: dict[str, tuple] = {}
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name = status.getPath().getName()
        found = _COMMIT.fullmatch(name)
        if found and status.isDirectory():
            run, key = found[1], (found[2], found[3], status.getPath().toString())
            first[run] = min(first.get(run, key), key)
    return {run: key[2] for run, key in first.items()}


def commit(rows: DataFrame, path: str, run_id: str) -> bool:
    """Add the rows of one run, one per ``model_name``; False, and nothing changes, where the run is committed already.

    ``run_id`` and ``committed_at`` (milliseconds) are added to the rows. Rows without a model name fail the commit, as do two rows of a name.
    """
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r}: letters, digits, '_' and '-' only")
    spark = rows.sparkSession
    if run_id in _commits(spark, path):
        return False
    now, own = int(time.time() * 1000), uuid.uuid4().hex
    fs, staged = _folder(spark, f"{path}/staging/{own}")
    rows.withColumn("run_id", F.lit(run_id)).withColumn("committed_at", F.lit(now).cast("long")).write.parquet(staged.toString())
    names = spark.read.parquet(staged.toString()).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model_name").alias("d")).first()
    if names["n"] != names["d"]:
        fs.delete(staged, True)
        raise ValueError("a run holds one row per model name")
    _, done = _folder(spark, f"{path}/commits/{run_id}.{now}.{own}")
    fs.mkdirs(done.getParent())
    if not fs.rename(staged, done):
        raise OSError(f"commit of run {run_id} could not be renamed into place")
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of whole commits: one per (model, run)."""
    folders = sorted(_commits(spark, path).values())
    if not folders:
        raise FileNotFoundError(f"no committed run below {path}")
    return spark.read.option("mergeSchema", True).parquet(*folders)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every model; of runs committed in the same millisecond the greater run id."""
    rows = read(spark, path)
    newest = F.max_by(F.struct(*rows.columns), F.struct("committed_at", "run_id")).alias("r")
    return rows.groupBy("model_name").agg(newest).select("r.*")
