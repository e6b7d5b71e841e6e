"""Registered queries of the operators: each applies its operator to its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import clusters, decontaminate, html_text, language, mixing, near_dedup, oracles, quality_model, quality_rules, recompress, secrets, urls, warc, whitening
from cohortlab.llm.common import compact, held_out, table

Builder = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    out = language.identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return compact(mixing.mixed_sizes(table(spark, sf_dir, "documents")))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    out = quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response record."""
    return warc.derive_pages(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential spans of every document."""
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    n = {f"n_{k}": F.size(secrets.base_of(F.col("spans"), k)).cast("long") for k in ("assign", "access", "hex")}
    return out.select("doc_id", *[c.alias(k) for k, c in n.items()], F.sha2(secrets.joined_spans(secrets.base_of(F.col("spans"))), 256).alias("base_sha256"),
                      secrets.joined_spans(F.col("spans")).alias("spans"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without the windows that a smaller doc_id holds."""
    out = recompress.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return compact(quality_rules.judged(table(spark, sf_dir, "documents")))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; pages that no rule fits are judged by the hosts that rules block often."""
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages"), rules)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after three rounds."""
    return clusters.with_digest(*clusters.clustered(table(spark, sf_dir, "embeddings")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Builder] = {f.__name__: f for f in (op1_language_id, op2_html_text, op3_decontaminate, op4_near_dedup, op5_mix_sources, op6_quality_model, op7_warc_derivatives, op8_secret_scan, op9_substring_dedup, op10_quality_rules, op11_url_filter, op12_centroid_clusters, op13_embedding_whitening)}
ORACLES: dict[str, str] = {
    "op3_decontaminate": oracles.decontaminate_sql(),
    "op4_near_dedup": oracles.near_dedup_sql(),
    "op9_substring_dedup": oracles.substring_dedup_sql(),
    "op10_quality_rules": oracles.quality_rules_sql(),
    "op11_url_filter": oracles.url_filter_sql(),
    "op12_centroid_clusters": oracles.centroid_clusters_sql(),
}
