"""Named queries: preprocessing, models, CV, calibration, serving, explanations (L*, U4-U6, P9-P13, J7-J10, M13/M14, X17/X18, S4/S8/S9)."""
from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab import constants as C
from cohortlab.operators import explain as ex
from cohortlab.operators import grouping as gr
from cohortlab.operators import metrics as me
from cohortlab.operators import modeling as mo
from cohortlab.operators import retrieval as rt
from cohortlab.operators import serving as sv
from cohortlab.operators.dictionaries import filled, long_values
from cohortlab.operators.prefix import exact_quantile_sql, fold_hash_sql
from cohortlab.plans.oracle import add_view
from cohortlab.plans.q_etl import features_of
from cohortlab.plans.registry import query
from cohortlab.session import ensure_checkpoint_dir, materialize
from cohortlab.sources import registry
from cohortlab.sources import tables as tb
from cohortlab.sources.standins import event_scores

#: Stored intermediates and fitted models of this application, by input folder and the files' state.
_CACHE: dict = {}


def _stamp(spark, sf_dir) -> tuple:
    """Application, folder, and modification time and length of the tables that the models are built from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = [spark.sparkContext.applicationId, sf_dir]
    for name in ("orders", "lineitem", "customer", "nation", "part"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        status = path.getFileSystem(conf).getFileStatus(path)
        out += [status.getModificationTime(), status.getLen()]
    return tuple(out)


def _features(spark, sf_dir):
    k = ("features", _stamp(spark, sf_dir))
    if k not in _CACHE:
        ensure_checkpoint_dir(spark)
        _CACHE[k] = features_of(spark, sf_dir).checkpoint(eager=True)
    return _CACHE[k]


def _parts(spark, sf_dir):
    """The training rows' fit and calibration parts, which do not depend on the model."""
    k = ("parts", _stamp(spark, sf_dir))
    if k not in _CACHE:
        train = _features(spark, sf_dir).where(F.col("split") == "train")
        _CACHE[k] = mo.stratified_holdout(train, "name").checkpoint(eager=True)
    return _CACHE[k]


def _serving(spark, sf_dir, feature_set="clean"):
    k = ("serving", _stamp(spark, sf_dir), feature_set)
    if k not in _CACHE:
        _CACHE[k] = sv.calibrate_feature_set(_features(spark, sf_dir), feature_set, parts=_parts(spark, sf_dir))
    return _CACHE[k]


def _served(spark, sf_dir):
    """Both served models by feature set; they are fitted concurrently."""
    _parts(spark, sf_dir)
    with ThreadPoolExecutor(max_workers=2) as pool:
        models = list(pool.map(lambda fs: _serving(spark, sf_dir, fs), C.FEATURE_SETS))
    return dict(zip(C.FEATURE_SETS, models))


def _fitted(spark, sf_dir, name):
    k = ("fit", _stamp(spark, sf_dir), name)
    if k not in _CACHE:
        f = _features(spark, sf_dir)
        _CACHE[k] = mo.fit(mo.spec_by_name(name), f.where(F.col("split") == "train"))
    return _CACHE[k]


def _fit_all(spark, sf_dir, names=None):
    """Fit the named catalogue models (None: all) by concurrent Spark jobs; ``_fitted`` then has them."""
    _features(spark, sf_dir)
    with ThreadPoolExecutor(max_workers=5) as pool:
        list(pool.map(lambda name: _fitted(spark, sf_dir, name), names or [s.name for s in mo.build_specs()]))


def _requests(spark, sf_dir):
    """The test companies as requests: every other one asks for the full model, every tenth names none."""
    f = _features(spark, sf_dir).where(F.col("split") == "test")
    n = F.col("name").cast("bigint")
    return f.withColumn("request_id", F.col("permalink")).withColumn(
        "feature_set", F.when(n % 10 == 0, F.lit(None).cast("string")).when(n % 2 == 0, "full").otherwise("clean"))


# ------------------------------------------------------------------ preprocessing (SQL-checked)

_NUM = C.FULL_NUMERIC_FEATURES


def _median_sql() -> str:
    parts = []
    for c in _NUM:
        q = exact_quantile_sql("(SELECT * FROM features WHERE split = 'train')", c, [0.5])
        parts.append(f"SELECT '{c}' AS feature, value AS median FROM {q} x")
    return " UNION ALL ".join(parts)


@query("l1_train_medians", ["features"], _median_sql())
def l1_train_medians(spark, sf_dir):
    """L1: exact medians of every numeric feature on the train split (not Imputer's approximation)."""
    return mo.medians(features_of(spark, sf_dir).where(F.col("split") == "train"), _NUM)


@query("l2_scaling_stats", ["features"], "WITH med AS (" + _median_sql() + ") " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(coalesce({c}, (SELECT median FROM med WHERE feature = '{c}'))), 6) AS mean,
           round(stddev_pop(coalesce({c}, (SELECT median FROM med WHERE feature = '{c}'))), 6) AS std
        FROM features WHERE split = 'train'""" for c in _NUM))
def l2_scaling_stats(spark, sf_dir):
    """L2: mean and population std of the median-imputed train columns."""
    train = features_of(spark, sf_dir).where(F.col("split") == "train")
    med = {r["feature"]: r["median"] for r in mo.medians(train, _NUM).collect()}  # one number per feature
    stats = mo.scaling_stats(train, _NUM, med)
    out = spark.createDataFrame([(c, float(m), float(s)) for c, (m, s) in stats.items()], "feature string, mean double, std double")
    return out.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("l3_missing_category", ["features"], """
  SELECT feature, value, count(*) AS n FROM (
    SELECT 'country_code' AS feature, coalesce(country_code, 'missing') AS value FROM features WHERE split = 'train'
    UNION ALL SELECT 'region', coalesce(region, 'missing') FROM features WHERE split = 'train'
    UNION ALL SELECT 'primary_category', coalesce(primary_category, 'missing') FROM features WHERE split = 'train') u
  GROUP BY feature, value""")
def l3_missing_category(spark, sf_dir):
    """L3: null categories become the 'missing' category (counts per value)."""
    train = features_of(spark, sf_dir).where(F.col("split") == "train")
    return long_values(train, C.CLEAN_CATEGORICAL_FEATURES, filled).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _onehot_sql() -> str:
    """Slot of each test row's known category values: numeric slots first, then one block of alphabetical labels per feature."""
    cats, blocks, before = C.CLEAN_CATEGORICAL_FEATURES, [], str(len(C.CLEAN_NUMERIC_FEATURES))
    for c in cats:
        labels = f"(SELECT DISTINCT coalesce({c}, 'missing') AS v FROM features WHERE split = 'train')"
        blocks.append(f"SELECT permalink, {before} + i AS slot FROM features JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM {labels} x) l "
                      f"ON l.v = coalesce({c}, 'missing') WHERE split = 'test'")
        before += f" + (SELECT count(*) FROM {labels} y)"
    return f"""
  SELECT f.permalink, coalesce(s.slots, []::BIGINT[]) AS slots FROM (SELECT permalink FROM features WHERE split = 'test') f
  LEFT JOIN (SELECT permalink, list(CAST(slot AS BIGINT) ORDER BY slot) AS slots FROM ({" UNION ALL ".join(blocks)}) u GROUP BY permalink) s USING (permalink)"""


@query("l4_onehot_slots", ["features"], _onehot_sql())
def l4_onehot_slots(spark, sf_dir):
    """L4: the one-hot slots that are set for each test row (an unseen category sets none)."""
    spec = mo.spec_by_name("logistic_regression_clean")
    f = _features(spark, sf_dir)
    stages, _, _ = mo.preprocess(spec, f.where(F.col("split") == "train").select(*spec.columns, "label"))
    rows = PipelineModel(stages).transform(f.where(F.col("split") == "test")).select("permalink", vector_to_array("features").alias("x"))
    first = len(spec.numeric)
    slots = F.filter(F.transform("x", lambda v, i: F.when((i >= first) & (v != 0), i.cast("bigint"))), lambda i: i.isNotNull())
    return rows.select("permalink", slots.alias("slots"))


@query("l5_ordinal_codes", ["features"], """
  WITH dict AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM (
                  SELECT DISTINCT 'primary_category' AS feature, coalesce(primary_category, 'missing') AS value
                  FROM features WHERE split = 'train'
                  UNION SELECT DISTINCT 'country_code', coalesce(country_code, 'missing') FROM features WHERE split = 'train') d)
  SELECT t.permalink, coalesce(a.code, -1) AS primary_category_code, coalesce(b.code, -1) AS country_code_code
  FROM features t
  LEFT JOIN dict a ON a.feature = 'primary_category' AND a.value = coalesce(t.primary_category, 'missing')
  LEFT JOIN dict b ON b.feature = 'country_code' AND b.value = coalesce(t.country_code, 'missing')
  WHERE t.split = 'test'""")
def l5_ordinal_codes(spark, sf_dir):
    """L5 + J7: the boosted pipeline's own codes, alphabetical over the train split; unseen test values -> -1."""
    spec = mo.spec_by_name("boosted_trees_clean")
    f = _features(spark, sf_dir)
    stages, _, _ = mo.preprocess(spec, f.where(F.col("split") == "train").select(*spec.columns, "label"))
    rows = PipelineModel(stages).transform(f.where(F.col("split") == "test"))
    return rows.select("permalink", *[F.col(f"{c}__o").cast("bigint").alias(f"{c}_code") for c in ["primary_category", "country_code"]])


@query("p9_feature_set_projection", ["features"], """
  SELECT 'clean' AS feature_set, 'founded_year,time_to_first_funding_days,country_code,region,primary_category' AS columns,
         count(*) AS n FROM features""")
def p9_feature_set_projection(spark, sf_dir):
    """Clean feature-set projection behind the leakage guard (the guard raises on leaky columns)."""
    df = mo.select_feature_set(features_of(spark, sf_dir), "clean")
    return df.agg(F.lit("clean").alias("feature_set"), F.lit(",".join(df.columns)).alias("columns"),
                  F.count(F.lit(1)).alias("n"))


@query("a10_numeric_ranges", ["features"], " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, (SELECT min({c}) FROM features WHERE split = 'train') AS min,
           (SELECT max({c}) FROM features WHERE split = 'train') AS max,
           round((SELECT value FROM {exact_quantile_sql("(SELECT * FROM features WHERE split = 'train')", c, [0.01])} q), 9) AS p01,
           round((SELECT value FROM {exact_quantile_sql("(SELECT * FROM features WHERE split = 'train')", c, [0.99])} q), 9) AS p99"""
    for c in _NUM))
def a10_numeric_ranges(spark, sf_dir):
    """A10: min / max / exact p01 / p99 per numeric feature on the train split."""
    r = ex.numeric_ranges(features_of(spark, sf_dir).where(F.col("split") == "train"), _NUM)
    return r.select("feature", "min", "max", F.round("p01", 9).alias("p01"), F.round("p99", 9).alias("p99"))


def _grid_sql(c: str) -> str:
    lo = f"(SELECT value FROM {exact_quantile_sql("(SELECT * FROM features WHERE split = 'train')", c, [0.01])} q)"
    hi = f"(SELECT value FROM {exact_quantile_sql("(SELECT * FROM features WHERE split = 'train')", c, [0.99])} q)"
    lo = f"greatest({lo}, 1980.0)" if c == "founded_year" else lo
    return (f"SELECT '{c}' AS feature, i, round(CASE WHEN i = 29 THEN hi ELSE CAST(i AS DOUBLE) * ((hi - lo) / 29.0) + lo END, 6) AS grid_value "
            f"FROM (SELECT {lo} AS lo, {hi} AS hi) r, range(0, 30) t(i)")


@query("l23_sensitivity_grid", ["features"], " UNION ALL ".join(_grid_sql(c) for c in _NUM))
def l23_sensitivity_grid(spark, sf_dir):
    """30-point grid p01..p99 of every numeric feature (founded_year floored at 1980)."""
    r = ex.numeric_ranges(features_of(spark, sf_dir).where(F.col("split") == "train"), _NUM).checkpoint(eager=True)
    out = None
    for c in _NUM:
        g = ex.numeric_grid(r, c, floor=C.PDP_FOUNDED_YEAR_FLOOR if c == "founded_year" else None)
        out = g if out is None else out.unionByName(g)
    return out.select("feature", F.col("i").cast("bigint").alias("i"), F.round("grid_value", 6).alias("grid_value"))


@query("l23_category_grid", ["features"], """
  SELECT feature, value, i FROM (
    SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) - 1 AS i FROM (
      SELECT 'country_code' AS feature, country_code AS value, count(*) AS n FROM features WHERE split = 'train' AND country_code IS NOT NULL GROUP BY country_code
      UNION ALL SELECT 'region', region, count(*) FROM features WHERE split = 'train' AND region IS NOT NULL GROUP BY region
      UNION ALL SELECT 'primary_category', primary_category, count(*) FROM features WHERE split = 'train' AND primary_category IS NOT NULL GROUP BY primary_category) a) b
  WHERE i < 20""")
def l23_category_grid(spark, sf_dir):
    """The 20 most frequent values of every categorical feature, ties by value."""
    train = features_of(spark, sf_dir).where(F.col("split") == "train")
    return ex.category_grid(train, C.CLEAN_CATEGORICAL_FEATURES).select("feature", "value", F.col("i").cast("bigint").alias("i"))


add_view("calsplit", ["features"], f"""
  SELECT name, label, CASE WHEN rk <= round(n_label * 0.2) THEN 'calibration' ELSE 'fit' END AS part FROM (
    SELECT name, label, row_number() OVER (PARTITION BY label ORDER BY {fold_hash_sql('name')}, CAST(name AS BIGINT)) AS rk,
           count(*) OVER (PARTITION BY label) AS n_label
    FROM features WHERE split = 'train') x""")


@query("l15_calibration_split", ["calsplit"], "SELECT name, label, part FROM calsplit")
def l15_calibration_split(spark, sf_dir):
    """Exact stratified 80/20 fit / calibration split by keyed-hash rank within label."""
    train = features_of(spark, sf_dir).where(F.col("split") == "train").withColumn("name", F.col("name").cast("bigint"))
    return mo.stratified_holdout(train.select("name", "label"), "name").withColumn(
        "name", F.col("name").cast("string")).select("name", "label", "part")


@query("l16_calibration_method", ["calsplit"], """
  SELECT count(*) AS n_calibration, CASE WHEN count(*) >= 1000 THEN 'isotonic' ELSE 'sigmoid' END AS method
  FROM calsplit WHERE part = 'calibration'""")
def l16_calibration_method(spark, sf_dir):
    """Isotonic when the calibration split has >= 1000 rows, else sigmoid."""
    n = l15_calibration_split(spark, sf_dir).where(F.col("part") == "calibration").count()
    return spark.createDataFrame([(n, mo.calibration_method(n))], "n_calibration bigint, method string")


@query("j8_split_disjointness", ["calsplit", "features"], """
  SELECT (SELECT count(*) FROM calsplit a JOIN calsplit b ON a.name = b.name AND a.part <> b.part) AS fit_cal_overlap,
         (SELECT count(*) FROM calsplit c JOIN features t ON t.name = c.name AND t.split = 'test') AS train_test_overlap,
         (SELECT count(*) FROM calsplit) AS n_train,
         (SELECT count(*) FROM features WHERE split = 'train') AS n_train_expected""")
def j8_split_disjointness(spark, sf_dir):
    """J8 + O1: fit / calibration / test are disjoint, and fit U calibration = train."""
    s = l15_calibration_split(spark, sf_dir)
    f = features_of(spark, sf_dir)
    fit, cal = s.where(F.col("part") == "fit"), s.where(F.col("part") == "calibration")
    test = f.where(F.col("split") == "test").select("name")
    a = fit.join(cal, "name", "left_semi").agg(F.count(F.lit(1)).alias("fit_cal_overlap"))
    b = s.join(test, "name", "left_semi").agg(F.count(F.lit(1)).alias("train_test_overlap"))
    c = fit.unionByName(cal).agg(F.count(F.lit(1)).alias("n_train"))
    d = f.where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n_train_expected"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)


@query("l8_dummy_test_metrics", ["features"], """
  WITH m AS (SELECT label AS mode FROM features WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
  s AS (SELECT label, CAST((SELECT mode FROM m) AS DOUBLE) AS score FROM features WHERE split = 'test')
  SELECT avg((score - label) * (score - label)) AS brier_score, avg(CAST(label AS DOUBLE)) AS positive_rate,
         count(*) AS n, max(score) AS constant FROM s""")
def l8_dummy_test_metrics(spark, sf_dir):
    """Most-frequent dummy (0/1 probability) scored on the test split."""
    f = features_of(spark, sf_dir)
    m = mo.fit(mo.spec_by_name("dummy_most_frequent"), f.where(F.col("split") == "train"))
    s = m.transform(f.where(F.col("split") == "test"))
    d = F.col("score") - F.col("label")
    return s.agg(F.avg(d * d).alias("brier_score"), F.avg(F.col("label").cast("double")).alias("positive_rate"),
                 F.count(F.lit(1)).alias("n"), F.max("score").alias("constant"))


@query("p13_decision", ["scores"], """
  SELECT key, CASE WHEN score * 100 >= 65 THEN 'likely success' WHEN score * 100 <= 35 THEN 'likely failure'
                   ELSE 'abstain' END AS decision FROM scores""")
def p13_decision(spark, sf_dir):
    """Three-way decision at tau = 65 over probabilities (event-score stand-in)."""
    s = event_scores(spark, sf_dir)
    return s.select("key", sv.decision(F.col("score") * 100).alias("decision"))


add_view("profiles", ["co_eff"], """
  SELECT permalink AS request_id, eff AS founded_date, first_d AS first_funding_date, last_d AS last_funding_date,
         CASE WHEN trim(funding_total_usd) = '-' THEN NULL ELSE CAST(replace(trim(funding_total_usd), ',', '') AS DOUBLE) END AS funding_total_usd,
         CAST(funding_rounds AS BIGINT) AS funding_rounds, country_code, region,
         split_part(category_list, '|', 1) AS primary_category,
         CASE WHEN CAST(name AS BIGINT) % 2 = 0 THEN 'full' ELSE 'clean' END AS feature_set,
         CAST(name AS BIGINT) % 7 AS batch_id
  FROM co_eff""")


def _profiles(spark, sf_dir):
    from cohortlab.operators import features as fe
    from cohortlab.sources.standins import companies_raw
    d = fe.add_dates(fe.label_and_filter(companies_raw(spark, sf_dir)))
    return d.select(
        F.col("permalink").alias("request_id"), F.col("_effective").alias("founded_date"),
        F.col("_first").alias("first_funding_date"), F.col("_last").alias("last_funding_date"),
        fe.funding_usd(F.col("funding_total_usd")).alias("funding_total_usd"),
        F.col("funding_rounds").cast("bigint").alias("funding_rounds"), "country_code", "region",
        F.split_part(F.col("category_list"), F.lit("|"), F.lit(1)).alias("primary_category"),
        F.when(F.col("name").cast("bigint") % 2 == 0, "full").otherwise("clean").alias("feature_set"),
        (F.col("name").cast("bigint") % 7).alias("batch_id"))


@query("p10_request_features", ["profiles"], """
  SELECT request_id, CAST(year(founded_date) AS DOUBLE) AS founded_year,
         CAST(date_diff('day', founded_date, first_funding_date) AS DOUBLE) AS time_to_first_funding_days,
         round(ln(1 + funding_total_usd), 9) AS funding_total_usd_log1p, CAST(funding_rounds AS DOUBLE) AS funding_rounds,
         CAST(date_diff('day', first_funding_date, last_funding_date) AS DOUBLE) AS funding_span_days,
         country_code, region, primary_category
  FROM profiles""")
def p10_request_features(spark, sf_dir):
    """P10: feature rows from profiles with dates and raw amounts."""
    r = sv.request_features(_profiles(spark, sf_dir))
    return r.withColumn("funding_total_usd_log1p", F.round("funding_total_usd_log1p", 9))


def _validated(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    req = sv.request_features(p).join(p.select("request_id", "funding_total_usd", "feature_set", "batch_id"),
                                      "request_id")
    return sv.validation_errors(req)


@query("p11_request_validation", ["profiles"], """
  SELECT request_id, list_filter([
      CASE WHEN year(founded_date) IS NULL OR year(founded_date) < 1900 OR year(founded_date) > 2100 THEN 'founded_year must be within [1900, 2100]' END,
      CASE WHEN date_diff('day', founded_date, first_funding_date) IS NULL THEN 'time_to_first_funding_days is required' END,
      CASE WHEN country_code IS NULL OR length(country_code) < 1 OR length(country_code) > 8 THEN 'country_code length must be 1..8' END,
      CASE WHEN region IS NULL OR length(region) < 1 THEN 'region must be non-empty' END,
      CASE WHEN primary_category IS NULL OR length(primary_category) < 1 THEN 'primary_category must be non-empty' END,
      CASE WHEN funding_total_usd < 0 THEN 'funding_total_usd must be >= 0' END,
      CASE WHEN funding_rounds < 1 THEN 'funding_rounds must be >= 1' END,
      CASE WHEN date_diff('day', first_funding_date, last_funding_date) < 0 THEN 'funding_span_days must be >= 0' END,
      CASE WHEN feature_set NOT IN ('clean', 'full') THEN 'feature_set must be clean or full' END,
      CASE WHEN feature_set = 'full' AND (funding_total_usd IS NULL OR funding_rounds IS NULL
                OR date_diff('day', first_funding_date, last_funding_date) IS NULL)
           THEN 'funding_total_usd, funding_rounds, and funding_span_days are required when feature_set=''full''' END],
      lambda x: x IS NOT NULL) AS errors
  FROM profiles""")
def p11_request_validation(spark, sf_dir):
    """Every broken rule per request (empty list = valid; non-empty = dead letter)."""
    return _validated(spark, sf_dir).select("request_id", "errors")


@query("p12_batch_contract", ["profiles"], """
  SELECT batch_id, count(*) AS batch_size, count(*) BETWEEN 1 AND 100 AS batch_ok FROM profiles GROUP BY batch_id""")
def p12_batch_contract(spark, sf_dir):
    """Batch size 1..100 per batch id."""
    b = sv.batch_contract(_profiles(spark, sf_dir))
    return b.select("batch_id", "batch_size", "batch_ok").distinct()


# ------------------------------------------------------------------ models (rows-only: fitted estimators)


@query("l9_l10_test_metrics")
def l9_l10_test_metrics(spark, sf_dir):
    """L6-L10 + M10: every catalogue model fit on train, metric bundle on test (one row per model)."""
    f = _features(spark, sf_dir)
    test = f.where(F.col("split") == "test")
    _fit_all(spark, sf_dir)
    rows = None
    for spec in mo.build_specs():
        s = _fitted(spark, sf_dir, spec.name).transform(test).select("label", "score")
        m = me.compute_metrics(s, 0.5).withColumn("model_name", F.lit(spec.name))
        rows = m if rows is None else rows.unionByName(m)
    return rows


@query("a17_leakage_gap")
def a17_leakage_gap(spark, sf_dir):
    """AUC(full) - AUC(clean) on the test split, logistic regression and boosted trees."""
    f = _features(spark, sf_dir)
    test = f.where(F.col("split") == "test")
    out = None
    families = ["logistic_regression", "boosted_trees"]
    _fit_all(spark, sf_dir, [f"{fam}_{fs}" for fam in families for fs in ("clean", "full")])
    for fam in families:
        aucs = [me.roc_auc(_fitted(spark, sf_dir, f"{fam}_{fs}").transform(test)).withColumn("fs", F.lit(fs))
                for fs in ("clean", "full")]
        a = aucs[0].unionByName(aucs[1]).groupBy().pivot("fs", ["clean", "full"]).agg(F.first("roc_auc"))
        a = a.select(F.lit(fam).alias("family"), F.col("clean").alias("auc_clean"), F.col("full").alias("auc_full"),
                     (F.col("full") - F.col("clean")).alias("leakage_gap"))
        out = a if out is None else out.unionByName(a)
    return out


def _cv_scores(spark, sf_dir, repeats=C.CV_REPEATS):
    """Stored out-of-fold scores (model_name, k, label, repeat, fold, score) of every catalogue model; fewer repeats are the first ones."""
    k = ("cv", _stamp(spark, sf_dir))
    if k not in _CACHE or _CACHE[k][0] < repeats:
        f = _features(spark, sf_dir).where(F.col("split") == "train").withColumn("k", F.col("name").cast("bigint"))
        _CACHE[k] = (repeats, mo.cross_validated(mo.build_specs(), f, "k", C.CV_FOLDS, repeats))
    return _CACHE[k][1].where(F.col("repeat") < repeats)


def _cv_summary(spark, sf_dir):
    """model_name, metric, mean, std, n_folds over the (repeat, fold) held-out parts."""
    scores, g = _cv_scores(spark, sf_dir), ["model_name", "repeat", "fold"]
    cells = materialize(me.score_cells(scores, g), "cv-cells")  # read by sketch, scan and totals of two metrics
    fm = (me.roc_auc(cells, g).join(me.average_precision(cells, g, digits=None), g).join(me.brier(scores, g, digits=None), g))
    lng = fm.selectExpr("model_name", "repeat", "fold", "stack(3, 'roc_auc', roc_auc, 'average_precision', average_precision, "
                        "'brier_score', brier_score) AS (metric, value)")
    return me.metric_summary(lng, ["model_name"], digits=6)


def _oof_thresholds(spark, sf_dir):
    """Each model's F0.5-best threshold on the first repeat's out-of-fold scores: every training row once."""
    return me.choose_threshold(_cv_scores(spark, sf_dir, 1).select("model_name", "label", "score"), group_cols=["model_name"])


def _per_spec(spark, sf_dir, one):
    """Union of ``one(spec)`` over the catalogue, with the model's name."""
    out = None
    for spec in mo.build_specs():
        part = one(spec).withColumn("model_name", F.lit(spec.name))
        out = part if out is None else out.unionByName(part)
    return out


@query("l12_cv_models")
def l12_cv_models(spark, sf_dir):
    """L12 + A18: stratified five-fold CV of every catalogue model, ten repeats."""
    return _cv_summary(spark, sf_dir).withColumn("repeats", F.lit(C.CV_REPEATS))


@query("l13_oof_threshold")
def l13_oof_threshold(spark, sf_dir):
    """L13 + M8: F0.5-best threshold on 5-fold out-of-fold probabilities of every catalogue model."""
    return _oof_thresholds(spark, sf_dir)


@query("l14_train_one")
def l14_train_one(spark, sf_dir):
    """L14 + S8: CV summary, OOF threshold, final fit, test metrics at that threshold - one registry row per model."""
    test = _features(spark, sf_dir).where(F.col("split") == "test")
    wide = _cv_summary(spark, sf_dir).groupBy("model_name").pivot("metric", ["roc_auc", "average_precision", "brier_score"]).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    thresholds = {r["model_name"]: r for r in _oof_thresholds(spark, sf_dir).collect()}  # one row per model
    _fit_all(spark, sf_dir)

    def one(spec):
        thr = thresholds[spec.name]
        model = _fitted(spark, sf_dir, spec.name)
        m = me.compute_metrics(model.transform(test).select("label", "score"), float(thr["threshold"]))
        meta = spark.createDataFrame([(spec.feature_set, spec.encoding, model.n_train, float(thr["best_f_beta"]))],
                                     "feature_set string, categorical_encoding string, n_train long, oof_f0_5 double")
        return meta.crossJoin(m)  # one row each

    return _per_spec(spark, sf_dir, one).join(wide, "model_name")


@query("m10_test_reliability")
def m10_test_reliability(spark, sf_dir):
    """M10 + M9: reliability curve of every catalogue model on the test split."""
    _fit_all(spark, sf_dir)
    test = _features(spark, sf_dir).where(F.col("split") == "test")
    return _per_spec(spark, sf_dir, lambda spec: me.reliability_curve(_fitted(spark, sf_dir, spec.name).transform(test).select("label", "score")))


@query("m13_model_comparison")
def m13_model_comparison(spark, sf_dir):
    """CV against test AUC of every model, and the family's leakage gap (full - clean) on the test split."""
    cv = l12_cv_models(spark, sf_dir).where("metric = 'roc_auc'").select("model_name", F.col("mean").alias("cv_roc_auc"))
    test = l9_l10_test_metrics(spark, sf_dir).select("model_name", F.col("roc_auc").alias("test_roc_auc"))
    both = test.join(cv, "model_name").withColumn("family", F.regexp_replace("model_name", "_(full|clean)$", ""))
    pick = lambda fs: F.max(F.when(F.col("model_name").endswith(fs), F.col("test_roc_auc")))
    gaps = both.groupBy("family").agg((pick("_full") - pick("_clean")).alias("leakage_gap"))
    return both.join(gaps, "family").select("model_name", "cv_roc_auc", "test_roc_auc", (F.col("cv_roc_auc") - F.col("test_roc_auc")).alias("cv_test_gap"), "leakage_gap")


@query("l24_model_info")
def l24_model_info(spark, sf_dir):
    """The two served models' newest registry rows, committed by concurrent writers and a replay, with the default set marked."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"served-{uuid.uuid4().hex}")
    models = _served(spark, sf_dir)
    with ThreadPoolExecutor(max_workers=3) as pool:  # a writer per model, and a replay of the default model's
        list(pool.map(lambda fs: registry.commit(sv.registry_row(spark, models[fs]), path, f"served-{fs}"), [*models, C.DEFAULT_FEATURE_SET]))
    rows = registry.latest(spark, path)
    return rows.select("feature_set", "model_name", "roc_auc_after", "brier_after", "n_test",
                       (F.col("feature_set") == C.DEFAULT_FEATURE_SET).alias("is_default"))


@query("l19_calibration_report")
def l19_calibration_report(spark, sf_dir):
    """L16-L19 + S8: calibrate both served boosted models; before / after Brier and AUC as registry rows."""
    rows = [sv.registry_row(spark, m) for m in _served(spark, sf_dir).values()]
    return rows[0].unionByName(rows[1])


@query("l20_batch_predictions")
def l20_batch_predictions(spark, sf_dir):
    """L20 + J2 + U4-U6 + L21: score every test company as a request table."""
    return sv.score_requests(_served(spark, sf_dir), _requests(spark, sf_dir))


@query("l21_tree_contributions")
def l21_tree_contributions(spark, sf_dir):
    """L21 + K3: exact path-dependent tree SHAP for both served models, top 5 by |value|; additivity residual per row."""
    out = None
    for name, m in _served(spark, sf_dir).items():
        c = ex.tree_contributions(m.base, _requests(spark, sf_dir), "request_id", top_n=len(m.base.spec.columns))
        total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["shap_value"])
        c = c.select("request_id", F.lit(name).alias("feature_set"), "base_value", "margin", F.slice("contributions", 1, C.TOP_N_CONTRIBUTIONS)
                     .alias("contributions"), (F.col("margin") - F.col("base_value") - total).alias("additivity_residual"))
        out = c if out is None else out.unionByName(c)
    return out


@query("l21_linear_contributions")
def l21_linear_contributions(spark, sf_dir):
    """L21 (linear): coef * (x - mean) contributions for the clean logistic model."""
    f = _features(spark, sf_dir)
    m = _fitted(spark, sf_dir, "logistic_regression_clean")
    return ex.linear_contributions(m, f.where(F.col("split") == "test"), f.where(F.col("split") == "train"), "permalink")


@query("l22_sensitivity_curve")
def l22_sensitivity_curve(spark, sf_dir):
    """L22 + J10: population curve of every numeric feature for both served models."""
    f = _features(spark, sf_dir)
    out = None
    for name, m in _served(spark, sf_dir).items():
        r = ex.numeric_ranges(f.where(F.col("split") == "train"), m.base.spec.numeric).checkpoint(eager=True)
        for feature in m.base.spec.numeric:
            grid = ex.numeric_grid(r, feature, floor=C.PDP_FOUNDED_YEAR_FLOOR if feature == "founded_year" else None)
            curve = ex.sensitivity(m.base, _requests(spark, sf_dir), "request_id", feature, grid, m.calibrator)
            curve = curve.groupBy("grid_value").agg(F.avg("predicted_probability").alias("mean_probability"), F.count(F.lit(1)).alias("n_requests"))
            curve = curve.select(F.lit(name).alias("feature_set"), F.lit(feature).alias("feature"), "grid_value", "mean_probability", "n_requests")
            out = curve if out is None else out.unionByName(curve)
    return out


@query("u4_bootstrap_band_check")
def u4_bootstrap_band_check(spark, sf_dir):
    """Bootstrap band per request; share bracketing the point and mean width."""
    s = l20_batch_predictions(spark, sf_dir)
    return s.agg(F.avg(F.col("brackets").cast("double")).alias("bracket_share"),
                 F.avg(F.col("band_upper") - F.col("band_lower")).alias("mean_width"),
                 F.count(F.lit(1)).alias("n"))


@query("x18_rendered_facts")
def x18_rendered_facts(spark, sf_dir):
    """X17 + X18 + J1: facts bundle per scored request (cohort back-off included) rendered as text."""
    s = l20_batch_predictions(spark, sf_dir)
    f = _features(spark, sf_dir)
    req = f.where(F.col("split") == "test").select(F.col("permalink").alias("request_id"), "country_code",
                                                    "primary_category", "funding_total_usd")
    cohorts = gr.cohort_lookup(req, f)
    return sv.render_facts(sv.facts(s, cohorts), foreground="founded_year")  # the feature that the table of requests asks about


@query("l25_report_lines")
def l25_report_lines(spark, sf_dir):
    """One-line report per scored request."""
    s = l20_batch_predictions(spark, sf_dir)
    f = _features(spark, sf_dir).select(F.col("permalink").alias("request_id"), "founded_year",
                                        "time_to_first_funding_days", "country_code", "region", "primary_category")
    j = s.join(f, "request_id")
    return j.select("request_id", F.format_string(
        "Startup Success Probability (calibrated, %s model): %.2f%%\n90%% confidence band: %.1f%% - %.1f%%\n"
        "Percentile vs. training cohort: %.1f%%\nFounded year: %.0f | Time to first funding: %.0f days\n"
        "Country: %s | Region: %s | Category: %s",
        F.col("feature_set"), F.col("probability") * 100, F.col("band_lower") * 100, F.col("band_upper") * 100,
        F.col("percentile"), F.col("founded_year"), F.col("time_to_first_funding_days"),
        F.col("country_code"), F.col("region"), F.col("primary_category")).alias("report"))


@query("l24_m13_model_registry")
def l24_m13_model_registry(spark, sf_dir):
    """L24 + M13 + S8: registry rows committed as one run and read back; test metrics per model."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"registry-{uuid.uuid4().hex}")
    metrics = l9_l10_test_metrics(spark, sf_dir).select("model_name", "roc_auc", "average_precision",
                                                        "brier_score", "n")
    registry.commit(metrics, path, "test-metrics")
    return registry.latest(spark, path).drop("run_id", "committed_at")


@query("m14_rescore_saved_model")
def m14_rescore_saved_model(spark, sf_dir):
    """Save the fitted pipeline, load it back and re-score the test split (metrics equal the fit's)."""
    m = _fitted(spark, sf_dir, "logistic_regression_full")
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    m.pipeline.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    test = _features(spark, sf_dir).where(F.col("split") == "test")
    s = loaded.transform(test).select("label", vector_to_array("probability")[1].alias("score"))
    return me.compute_metrics(s, 0.5)


@query("s4_feature_parquet_roundtrip", ["features"], "SELECT split, count(*) AS n FROM features GROUP BY split")
def s4_feature_parquet_roundtrip(spark, sf_dir):
    """S4 + S3: the feature table written partitioned by split and read back."""
    out = os.path.join(ensure_checkpoint_dir(spark), f"features-{uuid.uuid4().hex}")
    path = tb.write_features(features_of(spark, sf_dir, whole_categories=True), out)
    return tb.read_features(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s9_eval_questions_json", ["questions"], "SELECT qid, question FROM questions")
def s9_eval_questions_json(spark, sf_dir):
    """Eval questions written as a JSON array file and read back with an explicit schema."""
    q = tb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    out = os.path.join(ensure_checkpoint_dir(spark), f"questions-{uuid.uuid4().hex}")
    q.write.mode("overwrite").json(out)
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("question", T.StringType())])
    return spark.read.schema(schema).json(out)


_SET_COLUMNS = {"clean": (C.CLEAN_NUMERIC_FEATURES, C.CLEAN_CATEGORICAL_FEATURES), "full": (C.FULL_NUMERIC_FEATURES, C.FULL_CATEGORICAL_FEATURES)}


@query("s8_model_metadata", ["features", "co_boundary"], " UNION ALL ".join(f"""
  SELECT 'base_rate_{name}' AS model_name, '{name}' AS feature_set, '{",".join(num)}' AS numeric_features, '{",".join(cat)}' AS categorical_features,
         (DATE '1970-01-01' + CAST(floor((SELECT boundary_days FROM co_boundary)) AS INTEGER)) AS split_boundary,
         count_if(split = 'train') AS n_train, count_if(split = 'test') AS n_test,
         round(avg(CASE WHEN split = 'train' THEN CAST(label AS DOUBLE) END), 9) AS threshold FROM features""" for name, (num, cat) in _SET_COLUMNS.items()))
def s8_model_metadata(spark, sf_dir):
    """S8 + L24: metadata of the base-rate model of each feature set, as JSON in the registry: a first run, a newer one and its replay."""
    f = features_of(spark, sf_dir, keep_dates=True)
    facts = f.groupBy("split_boundary").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"),
        F.round(F.avg(F.when(F.col("split") == "train", F.col("label").cast("double"))), 9).alias("threshold"))
    models = F.explode(F.array(*[F.struct(F.lit(f"base_rate_{name}").alias("model_name"), F.lit(name).alias("feature_set"),
                                          F.lit(",".join(num)).alias("numeric_features"), F.lit(",".join(cat)).alias("categorical_features"))
                                 for name, (num, cat) in _SET_COLUMNS.items()]))
    rows = facts.select(models.alias("m"), "*").select("m.*", "split_boundary", "n_train", "n_test", "threshold")
    kept = rows.select("model_name", F.to_json(F.struct(*rows.columns)).alias("metadata"))
    path = os.path.join(ensure_checkpoint_dir(spark), f"metadata-{uuid.uuid4().hex}")
    registry.commit(kept.select("model_name", F.lit("{}").alias("metadata")), path, "run-1")
    for _ in range(2):
        registry.commit(kept, path, "run-2")
    return registry.latest(spark, path).select(F.from_json("metadata", rows.schema).alias("m")).select("m.*")


@query("s9_expected_chunks", ["questions", "expected"], """
  SELECT q.question, x.chunk_id FROM questions q LEFT JOIN expected x ON x.qid = q.qid""")
def s9_expected_chunks(spark, sf_dir):
    """Questions with their expected chunk ids, written as JSON arrays and read back by ``read_eval_questions``."""
    q = tb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    docs = tb.spread(tb.table(spark, sf_dir, "documents"))
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"))
    expected = rt.expected_by_containment(q, docs, ids).groupBy("qid").agg(F.sort_array(F.collect_list("chunk_id")).alias("expected_chunk_ids"))
    out = os.path.join(ensure_checkpoint_dir(spark), f"questions-{uuid.uuid4().hex}")
    tb.write_eval_questions(q.join(expected, "qid", "left").withColumn(
        "expected_chunk_ids", F.coalesce("expected_chunk_ids", F.array().cast("array<string>"))), out)
    return tb.read_eval_questions(spark, out).select("question", F.explode_outer("expected_chunk_ids").alias("chunk_id"))


def _request_rows(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    req = sv.request_features(p).join(p.select("request_id", "funding_total_usd", "feature_set", "batch_id"),
                                      "request_id")
    from cohortlab.streaming.scoring import REQUEST_SCHEMA
    return req.select(*[F.col(f.name).cast(f.dataType) for f in REQUEST_SCHEMA.fields])


@query("q1_stream_dead_letters", ["profiles"], """
  SELECT request_id, len(list_filter([
      CASE WHEN year(founded_date) IS NULL OR year(founded_date) < 1900 OR year(founded_date) > 2100 THEN 1 END,
      CASE WHEN date_diff('day', founded_date, first_funding_date) IS NULL THEN 1 END,
      CASE WHEN country_code IS NULL OR length(country_code) < 1 OR length(country_code) > 8 THEN 1 END,
      CASE WHEN region IS NULL OR length(region) < 1 THEN 1 END,
      CASE WHEN primary_category IS NULL OR length(primary_category) < 1 THEN 1 END,
      CASE WHEN funding_total_usd < 0 THEN 1 END,
      CASE WHEN funding_rounds < 1 THEN 1 END,
      CASE WHEN date_diff('day', first_funding_date, last_funding_date) < 0 THEN 1 END,
      CASE WHEN feature_set NOT IN ('clean', 'full') THEN 1 END,
      CASE WHEN feature_set = 'full' AND (funding_total_usd IS NULL OR funding_rounds IS NULL
                OR date_diff('day', first_funding_date, last_funding_date) IS NULL) THEN 1 END],
      lambda x: x IS NOT NULL)) AS n_errors
  FROM profiles
  WHERE len(list_filter([
      CASE WHEN year(founded_date) IS NULL OR year(founded_date) < 1900 OR year(founded_date) > 2100 THEN 1 END,
      CASE WHEN date_diff('day', founded_date, first_funding_date) IS NULL THEN 1 END,
      CASE WHEN country_code IS NULL OR length(country_code) < 1 OR length(country_code) > 8 THEN 1 END,
      CASE WHEN region IS NULL OR length(region) < 1 THEN 1 END,
      CASE WHEN primary_category IS NULL OR length(primary_category) < 1 THEN 1 END,
      CASE WHEN funding_total_usd < 0 THEN 1 END,
      CASE WHEN funding_rounds < 1 THEN 1 END,
      CASE WHEN date_diff('day', first_funding_date, last_funding_date) < 0 THEN 1 END,
      CASE WHEN feature_set NOT IN ('clean', 'full') THEN 1 END,
      CASE WHEN feature_set = 'full' AND (funding_total_usd IS NULL OR funding_rounds IS NULL
                OR date_diff('day', first_funding_date, last_funding_date) IS NULL) THEN 1 END],
      lambda x: x IS NOT NULL)) > 0""")
def q1_stream_dead_letters(spark, sf_dir):
    """Q1: request files drained by a file-source stream (availableNow); the dead-letter sink read back."""
    from cohortlab.streaming.scoring import run_stream
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    in_dir = os.path.join(base, "in")
    _request_rows(spark, sf_dir).write.parquet(in_dir)
    _, dead = run_stream(spark, in_dir, base)
    return spark.read.parquet(dead).drop("epoch").select("request_id", F.size("errors").cast("bigint").alias("n_errors"))


@query("q1_stream_scoring")
def q1_stream_scoring(spark, sf_dir):
    """Q1: the same stream with both calibrated models: valid requests scored by their feature set per micro-batch."""
    from cohortlab.streaming.scoring import run_stream
    m = _served(spark, sf_dir)
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    in_dir = os.path.join(base, "in")
    _request_rows(spark, sf_dir).write.parquet(in_dir)
    out, _ = run_stream(spark, in_dir, base, m)
    return spark.read.parquet(out)
