"""Q1: streaming scoring with dead-letter rows.

Request files land in a folder; a file-source stream with an explicit schema
reads them, and every micro-batch goes through exactly the batch functions
(``validation_errors`` then ``score_requests``) inside ``foreachBatch``. Valid
rows are scored, by the model of their feature set, into the epoch's folder of the output; rows that break
a request rule go to the dead-letter folder with their error list. No state is kept, so
no watermark is needed; the checkpoint makes the query restartable and the
``availableNow`` trigger drains the folder and stops.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.operators import serving as sv

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("feature_set", T.StringType()),
    T.StructField("founded_year", T.DoubleType()),
    T.StructField("time_to_first_funding_days", T.DoubleType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("funding_total_usd", T.DoubleType()),
    T.StructField("funding_rounds", T.DoubleType()),
    T.StructField("funding_span_days", T.DoubleType()),
])


def process_batch(batch: DataFrame, models: dict[str, sv.ServingModel] | sv.ServingModel | None, out_dir: str, dead_dir: str, epoch: int = 0) -> None:
    """The per-micro-batch body; also callable on a static DataFrame (batch = stream).

    Each epoch owns one folder of either sink and overwrites it, so a replayed micro-batch leaves the same rows.
    """
    checked = sv.validation_errors(batch).persist()
    try:
        checked.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{dead_dir}/epoch={epoch}")
        valid = checked.where(F.size("errors") == 0).drop("errors")
        if models is not None:
            valid = sv.score_requests(models, valid.withColumn(
                "funding_total_usd_log1p", F.log1p("funding_total_usd")), with_contributions=False)
        valid.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
    finally:
        checked.unpersist()


def run_stream(spark: SparkSession, in_dir: str, work_dir: str, models: dict[str, sv.ServingModel] | sv.ServingModel | None = None) -> tuple[str, str]:
    """Drain ``in_dir`` once (availableNow) and return (scored_dir, dead_letter_dir)."""
    out_dir, dead_dir = os.path.join(work_dir, "scored"), os.path.join(work_dir, "dead_letter")
    stream = spark.readStream.schema(REQUEST_SCHEMA).parquet(in_dir)
    q = (stream.writeStream
         .foreachBatch(lambda df, epoch: process_batch(df, models, out_dir, dead_dir, epoch))
         .option("checkpointLocation", os.path.join(work_dir, "checkpoint"))
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return out_dir, dead_dir
