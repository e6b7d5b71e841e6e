"""SparkSession defaults shared by tests, bench and the driver entry points."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cohortlab") -> SparkSession:
    """Build (or reuse) a session with the settings every module assumes.

    UTC session zone (driver timestamps are NTZ anyway), ANSI on, AQE with
    partition coalescing and skew-join splitting, Arrow for pandas transfer,
    and no UI server.
    """
    builder = SparkSession.builder.appName(app_name)
    fixed = {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # started here, not by spark-submit, which has set these
        fixed["spark.master"] = master or os.environ.get("COHORTLAB_MASTER", "local[8]")
        fixed["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(os.environ.get("COHORTLAB_SHUFFLE_PARTITIONS", "8")))
        fixed["spark.driver.memory"] = os.environ.get("COHORTLAB_DRIVER_MEMORY", "8g")
    builder = builder.config(map=fixed)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) do we create a scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="cohortlab-ckpt-", dir=os.environ.get("COHORTLAB_SCRATCH", "/tmp"))
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialize(df, label: str = "stage"):
    """Cut lineage: write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used where one intermediate is scanned several times (e.g. the labelled table,
    scanned for the date bound, the split quantile and the features). Reading the
    parquet back keeps column pruning and filter pushdown for every later scan;
    the files live in ``spark.checkpoint.dir`` so a lost executor does not lose them.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{label}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


#: Folders that ``materialize`` wrote in this process.
_WRITTEN: list[str] = []


def discard_intermediates(spark: SparkSession) -> None:
    """Delete what ``materialize`` has written; for callers whose results are out and who go on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
