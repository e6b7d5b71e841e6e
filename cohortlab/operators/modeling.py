"""Preprocessing, model specs, fitting, scoring, CV and calibration splits.

Everything data-sized stays in Spark: statistics are aggregates (exact medians
from ``exact_quantiles``), encoders are Spark ML stages, fits are Spark ML
estimators. The driver only sees constant-size summaries (one median / mean /
std per numeric feature) and the category labels of one-hot slots; ordinal codes are
a stored dictionary that is joined.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.operators import boosting as bo
from cohortlab.operators import logistic as lo
from cohortlab.operators.dictionaries import Dictionary
from cohortlab.operators.prefix import exact_quantiles, fold_hash, ranks
from cohortlab.session import materialize


@dataclass
class ModelSpec:
    name: str
    kind: str  # "dummy" | "lr" | "gbt"
    numeric: list
    categorical: list
    encoding: str  # "onehot" | "ordinal"
    feature_set: str  # "clean" | "full"
    needs_scaling: bool
    params: dict = field(default_factory=dict)

    @property
    def columns(self) -> list:
        return list(self.numeric) + list(self.categorical)


def build_specs() -> list[ModelSpec]:
    """The five-model catalogue."""
    cn, cc = C.CLEAN_NUMERIC_FEATURES, C.CLEAN_CATEGORICAL_FEATURES
    fn, fc = C.FULL_NUMERIC_FEATURES, C.FULL_CATEGORICAL_FEATURES
    return [
        ModelSpec("dummy_most_frequent", "dummy", fn, fc, "onehot", "full", False),
        ModelSpec("logistic_regression_full", "lr", fn, fc, "onehot", "full", True, {"maxIter": 2000}),
        ModelSpec("logistic_regression_clean", "lr", cn, cc, "onehot", "clean", True, {"maxIter": 2000}),
        ModelSpec("boosted_trees_full", "gbt", fn, fc, "ordinal", "full", False),
        ModelSpec("boosted_trees_clean", "gbt", cn, cc, "ordinal", "clean", False),
    ]


def spec_by_name(name: str) -> ModelSpec:
    return next(s for s in build_specs() if s.name == name)


def leakage_guard(columns: list, feature_set: str) -> None:
    """The clean set may not contain a leaky raw column or a feature derived from one."""
    if feature_set == "clean":
        bad = sorted(set(columns) & (set(C.LEAKY_COLUMNS) | set(C.LEAKY_FEATURES)))
        if bad:
            raise ValueError(f"leaky columns in the clean feature set: {bad}")


def select_feature_set(df: DataFrame, feature_set: str, extra: list | None = None) -> DataFrame:
    """Project a feature set (plus identity / label columns), guarded against leakage."""
    cols = (C.CLEAN_NUMERIC_FEATURES + C.CLEAN_CATEGORICAL_FEATURES if feature_set == "clean"
            else C.FULL_NUMERIC_FEATURES + C.FULL_CATEGORICAL_FEATURES)
    leakage_guard(cols, feature_set)
    return df.select(*cols, *(extra or []))


# ------------------------------------------------------------------ statistics (L1, L2)

# Integer-valued features (years, day counts, round counts): their distinct values are bounded
# by a calendar / count range, so Spark's exact ``percentile`` aggregate (one counter per
# distinct value) has bounded state and needs one pass. Continuous features use the
# distributed order-statistic path instead.
BOUNDED_DOMAIN = {"founded_year", "time_to_first_funding_days", "funding_rounds", "funding_span_days"}


def medians(train: DataFrame, cols: list) -> DataFrame:
    """L1: exact medians per numeric column (long format: feature, median)."""
    spark = train.sparkSession
    parts = []
    bounded = [c for c in cols if c in BOUNDED_DOMAIN]
    other = [c for c in cols if c not in BOUNDED_DOMAIN]
    if bounded:
        row = train.agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in bounded])
        stacked = ", ".join(f"'{c}', `{c}`" for c in bounded)
        parts.append(row.selectExpr(f"stack({len(bounded)}, {stacked}) AS (feature, median)"))
    if other:
        stacked = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in other)
        long = train.selectExpr(f"stack({len(other)}, {stacked}) AS (feature, value)")
        q = exact_quantiles(long, "value", [0.5], ["feature"])
        parts.append(q.select("feature", F.col("value").alias("median")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if parts else spark.createDataFrame([], "feature string, median double")


def scaling_stats(train: DataFrame, cols: list, med: dict) -> dict:
    """L2: mean and population std of the imputed column."""
    aggs = []
    for c in cols:
        x = F.coalesce(F.col(c).cast("double"), F.lit(med[c]))
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    row = train.agg(*aggs).first()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in cols}


# ------------------------------------------------------------------ pipeline

@dataclass
class FittedModel:
    spec: ModelSpec
    pipeline: PipelineModel | None
    medians: dict
    scaling: dict
    constant: float | None = None
    n_train: int = 0
    ensemble: bo.Ensemble | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` (positive-class probability)."""
        if self.spec.kind == "dummy":
            return df.withColumn("score", F.lit(float(self.constant)))
        out = self.pipeline.transform(df)
        if self.ensemble is not None:
            return out.withColumn("score", self.ensemble.probability(vector_to_array("features")))
        return out.withColumn("score", vector_to_array(F.col("probability"))[1]).drop(
            "rawPrediction", "probability", "prediction")

    def prepared(self, df: DataFrame) -> DataFrame:
        """The preprocessed feature vector only (stages before the classifier)."""
        stages = self.pipeline.stages if self.ensemble is not None else self.pipeline.stages[:-1]
        return PipelineModel(stages).transform(df)


def _prep_sql(spec: ModelSpec, med: dict, scale: dict) -> str:
    parts = []
    for c in spec.numeric:
        x = f"COALESCE(CAST(`{c}` AS DOUBLE), CAST({med[c]!r} AS DOUBLE))"
        if spec.needs_scaling:
            mu, sd = scale[c]
            sd = sd if sd and sd > 0 else 1.0
            x = f"(({x}) - CAST({mu!r} AS DOUBLE)) / CAST({sd!r} AS DOUBLE)"
        parts.append(f"{x} AS `{c}__p`")
    for c in spec.categorical:
        parts.append(f"COALESCE(CAST(`{c}` AS STRING), 'missing') AS `{c}__p`")
    return "SELECT *, " + ", ".join(parts) + " FROM __THIS__"


def _logistic(spec: ModelSpec, n_train: int) -> LogisticRegression:
    # sklearn's C=1 L2 penalty on a summed loss == regParam 1/n on Spark's mean loss
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False,
                              maxIter=spec.params.get("maxIter", 2000), tol=spec.params.get("tol", 1e-6))


def preprocess(spec: ModelSpec, train: DataFrame) -> tuple[list, dict, dict]:
    """Fitted stages that impute (exact median), scale, encode and assemble ``features``; medians; scaling."""
    med = {r["feature"]: r["median"] for r in medians(train, spec.numeric).collect()}
    scale = scaling_stats(train, spec.numeric, med) if spec.needs_scaling else {}
    sqlt = SQLTransformer(statement=_prep_sql(spec, med, scale))
    prepared = sqlt.transform(train)
    if spec.encoding == "onehot":  # a slot per category: the labels are as many as the model's coefficients
        idx = StringIndexer(inputCols=[f"{c}__p" for c in spec.categorical], outputCols=[f"{c}__i" for c in spec.categorical],
                            handleInvalid="keep", stringOrderType="alphabetAsc")
        idx_model = idx.fit(prepared)
        # dropLast drops the "unknown" slot StringIndexer(keep) appends: unseen -> all zeros
        ohe = OneHotEncoder(inputCols=[f"{c}__i" for c in spec.categorical],
                            outputCols=[f"{c}__v" for c in spec.categorical], dropLast=True)
        stages = [sqlt, idx_model, ohe.fit(idx_model.transform(prepared))]
        cat_out = [f"{c}__v" for c in spec.categorical]
    else:
        stages = [sqlt, Dictionary.fit(train, spec.categorical)]
        cat_out = [f"{c}__o" for c in spec.categorical]
    stages.append(VectorAssembler(inputCols=[f"{c}__p" for c in spec.numeric] + cat_out, outputCol="features"))
    return stages, med, scale


def fit(spec: ModelSpec, train: DataFrame) -> FittedModel:
    """Impute (exact median) -> scale -> encode -> assemble -> classifier."""
    leakage_guard(spec.columns, spec.feature_set)
    train = train.select(*spec.columns, "label")
    if spec.kind == "dummy":
        row = train.groupBy("label").count().orderBy(F.col("count").desc(), F.col("label").asc()).first()
        n = train.count()
        return FittedModel(spec, None, {}, {}, constant=float(row["label"]), n_train=n)
    stages, med, scale = preprocess(spec, train)
    assembled = PipelineModel(stages).transform(train)
    if spec.kind == "gbt":
        return boosted(spec, PipelineModel(stages), med, assembled)
    n = assembled.count()
    clf_model = _logistic(spec, n).fit(assembled.select("features", "label"))
    return FittedModel(spec, PipelineModel(stages + [clf_model]), med, scale, n_train=n)


def boosted(spec: ModelSpec, prepare: PipelineModel, med: dict, assembled: DataFrame) -> FittedModel:
    """One boosted fit on all rows of ``assembled``."""
    x = vector_to_array("features")
    key = F.xxhash64(x, "label")  # rows have no key of their own here; equal rows go to the same side of an early stop
    rows = materialize(assembled.select(key.alias("key"), "label", x.alias("x"), F.array().cast("array<int>").alias("folds")), "boosted-rows")
    width = len(spec.columns)
    edges = bo.bin_edges(rows, width)
    blocks = bo.packed(rows, edges, width, 0)
    run = bo.Boosting(blocks, edges, [bo.Fit(tuple(range(width)), iterations=spec.params.get("maxIter", bo.ITERATIONS))], 0)
    ensemble = run.run()[0]
    run.release()
    return FittedModel(spec, prepare, med, {}, n_train=rows.count(), ensemble=ensemble)


# ------------------------------------------------------------------ folds, CV, threshold

def assign_folds(train: DataFrame, key: str, n_splits: int = C.CV_FOLDS, repeats: int = 1,
                 seed: int = 42) -> DataFrame:
    """(repeat, fold) per row: rank of a keyed hash within (repeat, label), modulo k.

    All repeats are ranked in one distributed job (group = repeat x label).
    """
    rep = train.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rep = rep.withColumn("_h", fold_hash(F.col(key), seed) + F.col("repeat") * F.lit(7919))
    rep = rep.withColumn("_h", F.pmod(F.col("_h") * F.lit(40503) + F.col("repeat"), F.lit(4294967296)))
    r = ranks(rep, "_h", ["repeat", "label"], tie_cols=[key])
    return r.withColumn("fold", ((F.col("rank") - 1) % n_splits).cast("int")).drop("_h", "rank")


def folded(columns: list, train: DataFrame, key: str, n_splits: int, repeats: int, seed: int) -> DataFrame:
    """The columns that fits need, one row per training row with its fold in every repeat (``folds``), stored.

    Rows that share key and label share their folds: a company is never learned from and held out at once.
    """
    train = train.select(F.col(key).cast("long").alias(key), F.col("label").cast("int").alias("label"), *columns)
    long = assign_folds(train.select(key, "label").distinct(), key, n_splits, repeats, seed)
    wide = long.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("repeat", "fold"))).alias("z")).select(key, "label", F.transform("z", lambda z: z["fold"]).alias("folds"))
    return materialize(train.join(wide, [key, "label"]), "folds")


def cross_validated(specs: list[ModelSpec], train: DataFrame, key: str, n_splits: int = C.CV_FOLDS, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Held-out scores of every (model, repeat, fold) fit: model_name, key, label, repeat, fold, score, stored.

    All boosted fits share one set of passes, and so do all logistic ones. Medians, scaling and fold-wise constants are each fit's own; the boosted fits take
    the medians, category codes and bin edges of the whole training table, which do not look at labels.
    """
    for spec in specs:
        leakage_guard(spec.columns, spec.feature_set)
    numeric = list(dict.fromkeys(c for s in specs for c in s.numeric))
    categorical = list(dict.fromkeys(c for s in specs for c in s.categorical))
    rows = folded(numeric + categorical, train, key, n_splits, repeats, seed)
    jobs = [(r, f) for r in range(repeats) for f in range(n_splits)]
    runners = {"dummy": _dummy_scores, "gbt": _boosted_scores, "lr": _logistic_scores}
    out = None
    for kind, runner in runners.items():
        mine = [s for s in specs if s.kind == kind]
        if mine:
            part = runner(mine, rows, key, numeric, categorical, jobs)
            out = part if out is None else out.unionByName(part)
    return materialize(out, "cv-scores")


def cross_validated_scores(spec: ModelSpec, train: DataFrame, key: str, n_splits: int = C.CV_FOLDS, repeats: int = 1, seed: int = 42) -> DataFrame:
    """The held-out scores of one model: key, label, repeat, fold, score."""
    return cross_validated([spec], train, key, n_splits, repeats, seed).drop("model_name")


def _named(scores: DataFrame, specs: list[ModelSpec], jobs: list, key: str) -> DataFrame:
    """Fit numbers (spec by spec, job by job) as model_name, repeat, fold."""
    named = scores.sparkSession.createDataFrame([(i * len(jobs) + j, s.name, r, f) for i, s in enumerate(specs) for j, (r, f) in enumerate(jobs)], "fit int, model_name string, repeat int, fold int")
    return scores.join(F.broadcast(named), "fit").select("model_name", F.col("key").alias(key), "label", "repeat", "fold", "score")  # one row per fit


def _dummy_scores(specs, rows, key, numeric, categorical, jobs) -> DataFrame:
    """The most frequent label (the smaller on ties) of the other folds."""
    names = F.array(*[F.lit(s.name) for s in specs])
    long = rows.select(key, "label", F.posexplode("folds").alias("repeat", "fold"))
    counts = long.groupBy("repeat", "fold").agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg"))
    whole = counts.groupBy("repeat").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    fold = counts.join(whole, "repeat").select("repeat", "fold", F.when(F.col("all_pos") - F.col("pos") > F.col("all_neg") - F.col("neg"), 1.0).otherwise(0.0).alias("score"))
    return long.join(fold, ["repeat", "fold"]).select(F.explode(names).alias("model_name"), key, "label", "repeat", "fold", "score")


def _coded(rows: DataFrame, categorical: list, columns: list) -> tuple[list[int], DataFrame]:
    """Category columns as alphabetical codes (missing is a value of its own) behind ``columns``, in one array ``x``."""
    if not categorical:
        return [], rows.select(*rows.columns, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    codes = Dictionary.fit(rows, categorical)
    x = F.array(*[F.col(c).cast("double") for c in columns], *[F.col(f"{c}__o") for c in categorical])
    return codes.sizes(), codes.transform(rows).select(*rows.columns, x.alias("x"))


def _boosted_scores(specs, rows, key, numeric, categorical, jobs) -> DataFrame:
    med = {r["feature"]: r["median"] for r in medians(rows, numeric).collect()} if numeric else {}
    _, coded = _coded(rows.fillna({c: m for c, m in med.items() if m is not None}), categorical, numeric)
    columns, n_folds = numeric + categorical, len({r for r, _ in jobs})
    data = materialize(coded.select(F.col(key).alias("key"), "label", "x", "folds"), "boosted-rows")
    edges = bo.bin_edges(data, len(columns))
    fits = [bo.Fit(tuple(columns.index(c) for c in s.columns), r, f, s.params.get("maxIter", bo.ITERATIONS)) for s in specs for r, f in jobs]
    run = bo.Boosting(bo.packed(data, edges, len(columns), n_folds), edges, fits, n_folds)
    run.run()
    out = materialize(_named(run.out_of_fold(), specs, jobs, key), "boosted-scores")
    run.release()
    return out


def fold_medians(rows: DataFrame, columns: list, jobs: list) -> dict:
    """{(repeat, fold): {column: median of the rows outside the fold}} of the columns that have nulls."""
    have = rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first() if columns else {}
    gaps = [c for c in columns if have[c]]
    out: dict = {job: {} for job in jobs}
    if gaps:
        stacked = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in gaps)
        every = F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(f).alias("fold")) for r, f in jobs])
        outside = F.filter(every, lambda j: F.get("folds", j["repeat"]) != j["fold"])
        long = rows.selectExpr("folds", f"stack({len(gaps)}, {stacked}) AS (feature, value)").where("value IS NOT NULL").select("feature", "value", F.explode(outside).alias("j"))
        for r in exact_quantiles(long.select("feature", "value", "j.*"), "value", [0.5], ["feature", "repeat", "fold"]).collect():  # columns x fits
            out[(r["repeat"], r["fold"])][r["feature"]] = r["value"]
    return out


def logistic_tasks(specs: list[ModelSpec], rows: DataFrame, numeric: list, categorical: list, jobs: list, sizes: list[int]) -> list[lo.Task]:
    """One task per (spec, repeat, fold); columns are the numeric ones, then the category codes."""
    med = fold_medians(rows, numeric, jobs)
    return [lo.Task(bo.Fit((), r, f), [numeric.index(c) for c in s.numeric], [(len(numeric) + categorical.index(c), sizes[categorical.index(c)]) for c in s.categorical],
                    np.array([med[(r, f)].get(c, np.nan) for c in s.numeric], dtype=float)) for s in specs for r, f in jobs]


def _logistic_scores(specs, rows, key, numeric, categorical, jobs) -> DataFrame:
    sizes, coded = _coded(rows, categorical, numeric)
    if sum(sizes) + len(numeric) >= lo.SLOTS:  # curvatures would not fit: Spark ML's L-BFGS, fit by fit
        return _single_scores(specs, rows, key, jobs)
    n_folds = len({r for r, _ in jobs})
    blocks = bo.packed(coded.select(F.col(key).alias("key"), "label", "x", "folds"), None, len(numeric) + len(categorical), n_folds)
    run = lo.Logistic(blocks, logistic_tasks(specs, rows, numeric, categorical, jobs, sizes), n_folds)
    run.run()
    out = materialize(_named(run.out_of_fold(), specs, jobs, key), "logistic-scores")
    run.release()
    return out


def _single_scores(specs, rows, key, jobs, parallelism: int = 8) -> DataFrame:
    """Every fit on its own; fits run as concurrent Spark jobs."""

    def one(job):
        spec, (r, f) = job
        fold = F.get("folds", F.lit(r))
        held = fit(spec, rows.where(fold != f)).transform(rows.where(fold == f))
        return held.select(F.lit(spec.name).alias("model_name"), key, "label", F.lit(r).alias("repeat"), F.lit(f).alias("fold"), "score")

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        parts = list(ex.map(one, [(s, j) for s in specs for j in jobs]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stratified_holdout(train: DataFrame, key: str, fraction: float = C.CALIBRATION_FRACTION,
                       seed: int = 42) -> DataFrame:
    """Exact stratified split: per label, the round(fraction * n_label) lowest keyed hashes
    form the calibration part. Adds ``part`` in {'fit', 'calibration'}."""
    h = train.withColumn("_h", fold_hash(F.col(key), seed))
    r = ranks(h, "_h", ["label"], tie_cols=[key])
    n = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n_label"))
    r = r.join(F.broadcast(n), "label")  # one row per label value
    cut = F.round(F.col("_n_label") * F.lit(fraction))
    return (r.withColumn("part", F.when(F.col("rank") <= cut, F.lit("calibration")).otherwise(F.lit("fit")))
             .drop("_h", "rank", "_n_label"))


def calibration_method(n_calibration: int, threshold: int = C.ISOTONIC_MIN_ROWS) -> str:
    """Isotonic at or above 1000 rows, else sigmoid."""
    return "isotonic" if n_calibration >= threshold else "sigmoid"
