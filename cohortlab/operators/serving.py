"""Calibrated serving model: fit, evaluate, score a table of requests.

The reference scores one request at a time behind an HTTP handler; here every
step takes a request *table*: probability, raw score, percentile against the
training ECDF (as-of scan), bootstrap band, top contributions and the decision.
"""
from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.operators import calibration as ca
from cohortlab.operators import ecdf
from cohortlab.operators import explain as ex
from cohortlab.operators import metrics as me
from cohortlab.operators import modeling as mo
from cohortlab.operators import uncertainty as un


@dataclass
class ServingModel:
    name: str
    feature_set: str
    base: mo.FittedModel
    calibrator: ca.Calibrator
    method: str
    reference: ecdf.Ecdf       # stored distribution of the calibrated train scores
    bands: DataFrame           # U2 table on the test split
    curves: DataFrame          # bootstrap refits
    train: DataFrame           # fit + calibration rows (means of linear contributions)
    metadata: dict = field(default_factory=dict)

    @property
    def version(self) -> str:
        return f"{self.name}@{self.metadata.get('trained_at', '')}"


def calibrate_feature_set(features: DataFrame, feature_set: str, key: str = "name",
                          base_kind: str = "gbt", parts: DataFrame | None = None) -> ServingModel:
    """Base model on the fit part, calibrator on the held-out calibration part, metrics on test.

    ``parts``: the training rows with their part, where several models share them.
    """
    name = f"{'boosted_trees' if base_kind == 'gbt' else 'logistic_regression'}_{feature_set}_calibrated"
    spec = mo.spec_by_name(f"{'boosted_trees' if base_kind == 'gbt' else 'logistic_regression'}_{feature_set}")
    train = features.where(F.col("split") == "train")
    test = features.where(F.col("split") == "test")
    parts = mo.stratified_holdout(train, key).checkpoint(eager=True) if parts is None else parts
    fit_part = parts.where(F.col("part") == "fit")
    cal_part = parts.where(F.col("part") == "calibration")
    n_cal = cal_part.count()
    method = mo.calibration_method(n_cal)
    base = mo.fit(spec, fit_part)
    cal_raw = base.transform(cal_part).withColumnRenamed("score", "raw_score").checkpoint(eager=True)
    calibrator = ca.fit_calibrator(cal_raw, method)
    # O1: the reference distribution is every training row (fit + calibration), calibrated
    train_all = fit_part.unionByName(cal_part)
    # the test scoring, the reference scores and the bootstrap curves are independent jobs
    with ThreadPoolExecutor(max_workers=3) as pool:
        f_test = pool.submit(lambda: calibrator.transform(
            base.transform(test).withColumnRenamed("score", "raw_score")).checkpoint(eager=True))
        f_ref = pool.submit(lambda: ecdf.store(calibrator.transform(
            base.transform(train_all).withColumnRenamed("score", "raw_score")), "probability"))
        f_curves = pool.submit(lambda: ca.bootstrap_curves(ca.bootstrap_cells(cal_raw), method).checkpoint(eager=True))
        test_scored, reference, curves = f_test.result(), f_ref.result(), f_curves.result()
    before = me.compute_metrics(test_scored.select("label", F.col("raw_score").alias("score")), 0.5).first()
    after = me.compute_metrics(test_scored.select("label", F.col("probability").alias("score")), 0.5).first()
    bands = un.confidence_bands(test_scored.select("label", F.col("probability").alias("score"))).checkpoint(eager=True)
    meta = {
        "model_name": name, "feature_set": feature_set, "calibration_method": method,
        "numeric_features": ",".join(spec.numeric), "categorical_features": ",".join(spec.categorical),
        "n_train_fit": fit_part.count(), "n_calibration": n_cal, "n_test": test.count(),
        "brier_before": before["brier_score"], "brier_after": after["brier_score"],
        "roc_auc_before": before["roc_auc"], "roc_auc_after": after["roc_auc"],
        "trained_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
    }
    return ServingModel(name, feature_set, base, calibrator, method, reference, bands, curves, train_all, meta)


def registry_row(spark, model: ServingModel) -> DataFrame:
    """The metadata as a one-row DataFrame (appendable to a registry table)."""
    return spark.createDataFrame([model.metadata])


def _contributions(model: ServingModel, requests: DataFrame, key: str) -> DataFrame:
    if model.base.spec.kind == "gbt":
        return ex.tree_contributions(model.base, requests, key).select(key, "contributions")
    return ex.linear_contributions(model.base, requests, model.train, key)


def _score(model: ServingModel, requests: DataFrame, key: str, with_contributions: bool) -> DataFrame:
    raw = model.base.transform(requests).withColumnRenamed("score", "raw_score")
    # read three times: as-of sketch and scan, band
    scored = model.calibrator.transform(raw).select(key, "raw_score", "probability").checkpoint(eager=True)
    pct = un.percentile_of(scored.select(key, "probability"), model.reference)
    out = scored.join(pct.select(key, "percentile"), key)
    band = un.collapse_on_failure(ca.bootstrap_band(out, model.curves, "raw_score", method=model.method))
    if with_contributions:
        band = band.join(_contributions(model, requests, key), key, "left")
    return band.withColumn("model_version", F.lit(model.version)).withColumn("feature_set", F.lit(model.feature_set))


def score_requests(models: ServingModel | dict[str, ServingModel], requests: DataFrame, key: str = "request_id",
                   with_contributions: bool = True) -> DataFrame:
    """Probability, raw score, percentile, bootstrap band (+ check), contributors, version.

    ``models`` by feature set: each request is scored by the model of its own ``feature_set`` (null:
    the default set). A single model scores every request.
    """
    if isinstance(models, ServingModel):
        return _score(models, requests, key, with_contributions)
    chosen = F.coalesce(F.col("feature_set"), F.lit(C.DEFAULT_FEATURE_SET))
    out = None
    for name, model in models.items():
        part = _score(model, requests.where(chosen == name), key, with_contributions)
        out = part if out is None else out.unionByName(part)
    return out


def decision(prob_pct, threshold: int = C.DECISION_THRESHOLD_PCT):
    """Success / failure / abstain at a confidence threshold tau (percent)."""
    return (F.when(prob_pct >= threshold, F.lit("likely success"))
            .when(prob_pct <= 100 - threshold, F.lit("likely failure"))
            .otherwise(F.lit("abstain")))


# ------------------------------------------------------------------ request validation

def request_features(profiles: DataFrame) -> DataFrame:
    """P10: model inputs from a table of profiles with dates and raw amounts."""
    return profiles.select(
        "request_id",
        F.year("founded_date").cast("double").alias("founded_year"),
        F.datediff("first_funding_date", "founded_date").cast("double").alias("time_to_first_funding_days"),
        F.log1p(F.col("funding_total_usd").cast("double")).alias("funding_total_usd_log1p"),
        F.col("funding_rounds").cast("double").alias("funding_rounds"),
        F.datediff("last_funding_date", "first_funding_date").cast("double").alias("funding_span_days"),
        "country_code", "region", "primary_category")


def validation_errors(req: DataFrame) -> DataFrame:
    """Adds ``errors ARRAY<STRING>`` with every rule a request breaks (empty = valid). A null feature set is the default."""
    checks = [
        (F.col("founded_year").isNull() | (F.col("founded_year") < 1900) | (F.col("founded_year") > 2100),
         "founded_year must be within [1900, 2100]"),
        (F.col("time_to_first_funding_days").isNull(), "time_to_first_funding_days is required"),
        (F.col("country_code").isNull() | (F.length("country_code") < 1) | (F.length("country_code") > 8),
         "country_code length must be 1..8"),
        (F.col("region").isNull() | (F.length("region") < 1), "region must be non-empty"),
        (F.col("primary_category").isNull() | (F.length("primary_category") < 1), "primary_category must be non-empty"),
        (F.col("funding_total_usd") < 0, "funding_total_usd must be >= 0"),
        (F.col("funding_rounds") < 1, "funding_rounds must be >= 1"),
        (F.col("funding_span_days") < 0, "funding_span_days must be >= 0"),
        (F.col("funding_rounds").cast("double") != F.floor(F.col("funding_rounds").cast("double")), "funding_rounds must be an integer"),
        (~F.col("feature_set").isin("clean", "full"), "feature_set must be clean or full"),
        ((F.col("feature_set") == "full") & (F.col("funding_total_usd").isNull() | F.col("funding_rounds").isNull()
                                             | F.col("funding_span_days").isNull()),
         "funding_total_usd, funding_rounds, and funding_span_days are required when feature_set='full'"),
    ]
    arr = F.array(*[F.when(c, F.lit(msg)) for c, msg in checks])
    return req.withColumn("errors", F.filter(arr, lambda x: x.isNotNull()))


def batch_contract(req: DataFrame, max_batch: int = C.MAX_BATCH_SIZE) -> DataFrame:
    """Per batch_id size must be 1..max_batch; adds ``batch_ok``."""
    sizes = req.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_size"))
    return req.join(sizes, "batch_id").withColumn("batch_ok", (F.col("batch_size") >= 1) & (F.col("batch_size") <= max_batch))


# ------------------------------------------------------------------ facts

def facts(scored: DataFrame, cohorts: DataFrame, key: str = "request_id") -> DataFrame:
    """A facts struct per request from scoring output and the cohort lookup."""
    j = scored.join(cohorts, key, "left")
    return j.select(key, F.struct(
        F.col("probability"), F.col("raw_score").alias("raw_probability"),
        F.col("band_lower"), F.col("band_upper"), F.col("percentile"),
        F.col("contributions").alias("top_contributions"),
        F.col("level").alias("cohort_level"), F.col("country_code").alias("cohort_country"),
        F.col("cohort_category"), F.col("cohort_n"), F.col("cohort_success_rate")).alias("facts"))


def _pct1(x):
    return F.format_string("%.1f%%", x * 100)


def format_value(feature: Column, value: Column) -> Column:
    """Numbers with two decimals, categories as they are (T-values print as the reference's floats do)."""
    number = F.when(value.isNull(), F.lit("nan")).otherwise(F.format_string("%.2f", value.try_cast("double")))
    return F.when(feature.isin(*C.FULL_NUMERIC_FEATURES), number).otherwise(F.coalesce(value, F.lit("None")))


def render_facts(facts_df: DataFrame, key: str = "request_id", foreground: str | Column | None = None) -> DataFrame:
    """The facts as Markdown text. ``foreground``: a feature, or a column that names one per row."""
    f = F.col("facts")
    contrib = f["top_contributions"]
    band = F.concat(F.lit(C.FACTS_BAND), _pct1(f["band_lower"]), F.lit("-"), _pct1(f["band_upper"]), F.lit(")"))
    lines = [F.lit(C.FACTS_HEADER), F.concat(F.lit(C.FACTS_PROBABILITY), _pct1(f["probability"]), band),
             F.concat(F.lit(C.FACTS_RAW), _pct1(f["raw_probability"]), F.lit(C.FACTS_RAW_NOTE)),
             F.concat(F.lit(C.FACTS_PERCENTILE), F.format_string("%.1f%%", f["percentile"]), F.lit("**"))]
    rows = F.transform(contrib, lambda c: F.format_string(
        "| `%s` | %s | %+.3f | %s |", c["feature"], format_value(c["feature"], c["value"]), c["shap_value"], c["direction"]))
    table = F.when(F.size(contrib) > 0, F.concat_ws("\n", F.lit(""), *[F.lit(x) for x in C.FACTS_TABLE_HEAD], F.array_join(rows, "\n")))
    asked = F.lit(None).cast("string") if foreground is None else F.lit(foreground) if isinstance(foreground, str) else foreground
    named = F.get(F.filter(contrib, lambda c: c["feature"] == asked), F.lit(0))
    shown = F.when(named.isNotNull(), F.format_string(
        C.FACTS_FOREGROUND, asked, named["direction"], named["shap_value"], format_value(named["feature"], named["value"])))
    level = F.replace(F.replace(f["cohort_level"], F.lit("+"), F.lit(" + ")), F.lit("_"), F.lit(" "))
    cohort = F.when(f["cohort_level"].isNotNull(), F.concat(
        F.lit(C.FACTS_COHORT), level, F.lit(" = "), f["cohort_country"],
        F.when(f["cohort_category"].isNotNull(), F.concat(F.lit(", "), f["cohort_category"])).otherwise(F.lit("")),
        F.lit(", n="), f["cohort_n"].cast("string"), F.lit(C.FACTS_COHORT_RATE),
        _pct1(f["cohort_success_rate"]), F.lit(C.FACTS_COHORT_END))).otherwise(F.lit(C.NO_COHORT_TEXT))
    return facts_df.select(key, F.concat_ws("\n", *lines, shown, table, cohort).alias("answer"))
