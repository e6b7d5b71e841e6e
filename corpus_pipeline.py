"""Corpus pipeline over ``documents``: language ID, near-dedup, decontamination, secret scan, source mix.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns they came
with; the last returns the mix. ``run`` writes every stage's result to the shared checkpoint folder and reads it
again for the next stage, as a scheduler of separate jobs would.

A document that the language stage rejects has no letter or an ambiguous language, one of each near-duplicate group stays (its smallest
doc_id), contaminated documents go, spans of secrets are replaced by a mark, and the mix draws what is left to the
sources' targets, one row per copy. Rows with a null doc_id have no identity and are dropped by the first stage; rows that
share a doc_id are one document, of which the near-dedup stage keeps the row whose text sorts first (null before all).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import decontaminate, language, mixing, near_dedup, secrets
from cohortlab.llm.common import held_out, merged, stored, table


def _only(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ``good``."""
    ids = good.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(merged(ids), docs["doc_id"].cast("long") == ids["_id"], "left_semi")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the classifiers are fitted on the whole table's labelled rows."""
    labelled = table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    found = language.predict(docs, language.fit(labelled))
    return _only(docs, found.where("lang_pred <> 'und' AND NOT ambiguous"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    one = docs.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", "lang", "source")).alias("r")).select("r.*")
    return _only(one, near_dedup.near_duplicates(docs).where("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _only(docs, found.where("NOT contaminated"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("source_mix", mix_stage),
]

#: The stages are not expressible in SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
