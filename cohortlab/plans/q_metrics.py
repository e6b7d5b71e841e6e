"""Named queries: metrics, thresholds, curves, folds, bands and percentiles on the event scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import calibration as ca
from cohortlab.operators import metrics as me
from cohortlab.operators import uncertainty as un
from cohortlab.operators.prefix import exact_quantile_sql, fold_hash, fold_hash_sql, ranks
from cohortlab.plans.oracle import add_view
from cohortlab.plans.registry import query
from cohortlab.session import materialize
from cohortlab.sources.standins import event_scores


def scores(spark, sf_dir):
    return event_scores(spark, sf_dir)


def folds(spark, sf_dir, k: int = 5, seed: int = 42):
    """Stratified fold = (rank of keyed hash within label - 1) % k (distributed ranks)."""
    s = scores(spark, sf_dir).withColumn("h", fold_hash(F.col("key"), seed))
    r = ranks(s, "h", ["label"], tie_cols=["key"])
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("h")


add_view("folds", ["scores"], f"""
  SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {fold_hash_sql('key')}, key) - 1) % 5 AS INTEGER) AS fold
  FROM scores""")


def auc_sql(src: str, g: str | None = None) -> str:
    gs, gp, gb = (f"{g}, ", f"PARTITION BY {g} ", f" GROUP BY {g}") if g else ("", "", "")
    return f"""SELECT {gs}CAST(sum(pos * (2 * (cum_neg - neg) + neg)) AS DOUBLE)
         / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc
  FROM (SELECT *, sum(neg) OVER ({gp}ORDER BY score) AS cum_neg
        FROM (SELECT {gs}score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY {gs}score) c) w{gb}"""


def ap_sql(src: str, g: str | None = None, digits: int | None = 9) -> str:
    gs, gp, gb = (f"{g}, ", f"PARTITION BY {g} ", f" GROUP BY {g}") if g else ("", "", "")
    v = "sum(CAST(pos AS DOUBLE) * cum_pos / (cum_pos + cum_neg)) / sum(pos)"
    v = f"round({v}, {digits})" if digits is not None else v
    return f"""SELECT {gs}{v} AS average_precision
  FROM (SELECT *, sum(pos) OVER ({gp}ORDER BY score DESC) AS cum_pos, sum(neg) OVER ({gp}ORDER BY score DESC) AS cum_neg
        FROM (SELECT {gs}score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY {gs}score) c) w{gb}"""


def brier_sql(src: str, g: str | None = None, digits: int | None = 10) -> str:
    gs, gb = (f"{g}, ", f" GROUP BY {g}") if g else ("", "")
    v = "avg((score - label) * (score - label))"
    v = f"round({v}, {digits})" if digits is not None else v
    return f"SELECT {gs}{v} AS brier_score FROM {src}{gb}"


def confusion_sql(src: str, t: float) -> str:
    return f"""SELECT {t!r} AS threshold, tn, fp, fn, tp,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN tp = 0 THEN 0.0 ELSE CAST(2.0 * tp AS DOUBLE) / CAST(2.0 * tp + 1.0 * fn + fp AS DOUBLE) END AS f1,
         CASE WHEN tp = 0 THEN 0.0 ELSE CAST(1.25 * tp AS DOUBLE) / CAST(1.25 * tp + 0.25 * fn + fp AS DOUBLE) END AS f0_5,
         positive_rate, n
  FROM (SELECT count_if(score < {t!r} AND label <> 1) AS tn, count_if(score >= {t!r} AND label <> 1) AS fp,
               count_if(score < {t!r} AND label = 1) AS fn, count_if(score >= {t!r} AND label = 1) AS tp,
               avg(CAST(label AS DOUBLE)) AS positive_rate, count(*) AS n FROM {src}) c"""


@query("m1_roc_auc", ["scores"], auc_sql("scores"))
def m1_roc_auc(spark, sf_dir):
    """ROC AUC with half-counted ties via distributed running sums over score cells."""
    return me.roc_auc(scores(spark, sf_dir))


@query("m2_average_precision", ["scores"], ap_sql("scores"))
def m2_average_precision(spark, sf_dir):
    """M2: step-wise average precision."""
    return me.average_precision(scores(spark, sf_dir))


@query("m3_brier", ["scores"], brier_sql("scores"))
def m3_brier(spark, sf_dir):
    """M3: Brier score."""
    return me.brier(scores(spark, sf_dir))


@query("m4_confusion_at_half", ["scores"], confusion_sql("scores", 0.5))
def m4_confusion_at_half(spark, sf_dir):
    """M4-M6: confusion matrix, precision/recall/F1/F0.5, positive rate and n at t = 0.5."""
    return me.confusion_at(scores(spark, sf_dir), 0.5)


@query("m7_metric_bundle", ["scores"], f"""
  SELECT * FROM ({confusion_sql('scores', 0.5)}) a, ({auc_sql('scores')}) b, ({ap_sql('scores')}) c, ({brier_sql('scores')}) d""")
def m7_metric_bundle(spark, sf_dir):
    """The compute_metrics bundle in one row."""
    return me.compute_metrics(scores(spark, sf_dir), 0.5)


_CANDS = ", ".join(f"({i + 1}, CAST({c!r} AS DOUBLE))" for i, c in enumerate(me.threshold_candidates()))


@query("m8_threshold_table", ["scores"], f"""
  SELECT t.threshold, count_if(s.score >= t.threshold AND s.label = 1) AS tp,
         count_if(s.score >= t.threshold AND s.label = 0) AS fp,
         count_if(s.score < t.threshold AND s.label = 1) AS fn,
         CASE WHEN count_if(s.score >= t.threshold AND s.label = 1) = 0 THEN 0.0
              ELSE CAST(1.25 * count_if(s.score >= t.threshold AND s.label = 1) AS DOUBLE)
                   / CAST(1.25 * count_if(s.score >= t.threshold AND s.label = 1)
                          + 0.25 * count_if(s.score < t.threshold AND s.label = 1)
                          + count_if(s.score >= t.threshold AND s.label = 0) AS DOUBLE) END AS f_beta
  FROM (VALUES {_CANDS}) t(j, threshold) CROSS JOIN scores s GROUP BY t.threshold""")
def m8_threshold_table(spark, sf_dir):
    """M8 support: F0.5 at each of the 99 candidates from <= 100 bucket cells."""
    return me.threshold_table(scores(spark, sf_dir))


@query("m8_choose_threshold", ["scores"], f"""
  SELECT threshold, f_beta AS best_f_beta FROM (
    SELECT t.threshold,
         CASE WHEN count_if(s.score >= t.threshold AND s.label = 1) = 0 THEN 0.0
              ELSE CAST(1.25 * count_if(s.score >= t.threshold AND s.label = 1) AS DOUBLE)
                   / CAST(1.25 * count_if(s.score >= t.threshold AND s.label = 1)
                          + 0.25 * count_if(s.score < t.threshold AND s.label = 1)
                          + count_if(s.score >= t.threshold AND s.label = 0) AS DOUBLE) END AS f_beta
    FROM (VALUES {_CANDS}) t(j, threshold) CROSS JOIN scores s GROUP BY t.threshold) x
  ORDER BY f_beta DESC, threshold ASC LIMIT 1""")
def m8_choose_threshold(spark, sf_dir):
    """M8 + K5: F0.5-maximising threshold, first maximum wins."""
    return me.choose_threshold(scores(spark, sf_dir))


_RC_Q = exact_quantile_sql("scores", "score", me.quantile_fracs(10)[1:-1])


@query("m9_reliability_curve", ["scores"], f"""
  SELECT bin, round(avg(score), 6) AS mean_predicted, avg(CAST(label AS DOUBLE)) AS fraction_positive, count(*) AS n
  FROM (SELECT s.score, s.label, (SELECT count(*) FROM {_RC_Q} e WHERE e.value < s.score) AS bin FROM scores s) b
  GROUP BY bin""")
def m9_reliability_curve(spark, sf_dir):
    """M9: reliability curve with exact quantile edges (right-closed inner edges)."""
    return me.reliability_curve(scores(spark, sf_dir))


@query("m11_roc_points", ["scores"], """
  SELECT threshold, fpr, tpr FROM (
    SELECT score AS threshold, sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER () AS fpr,
           sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () AS tpr
    FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY score) c) p
  UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def m11_roc_points(spark, sf_dir):
    """Full ROC curve, one point per distinct score plus the origin."""
    return me.roc_points(scores(spark, sf_dir))


@query("m12_pr_points", ["scores"], """
  SELECT threshold, precision, recall FROM (
    SELECT score AS threshold,
           sum(pos) OVER (ORDER BY score DESC) / (sum(pos) OVER (ORDER BY score DESC) + sum(neg) OVER (ORDER BY score DESC)) AS precision,
           sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () AS recall
    FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY score) c) p
  UNION ALL SELECT CAST('inf' AS DOUBLE), 1.0, 0.0""")
def m12_pr_points(spark, sf_dir):
    """PR curve points."""
    return me.pr_points(scores(spark, sf_dir))


#: Points of the bounded curves.
MAX_POINTS = 100
_CURVE_SQL = """
  cells AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
            FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY score) c)"""


@query("m11_roc_bounded", ["scores"], f"""
  WITH {_CURVE_SQL},
  slots AS (SELECT *, least(floor((fp / n + tp / p) / 2 * {(MAX_POINTS - 1) // 3}), {(MAX_POINTS - 1) // 3 - 1}) AS slot FROM cells),
  ends AS (SELECT slot, max(score) AS first_score, min(score) AS last_score, arg_max(tp, score) AS atp, arg_max(fp, score) AS afp,
                  arg_min(tp, score) AS btp, arg_min(fp, score) AS bfp FROM slots GROUP BY slot),
  high AS (SELECT s.*, first_score, last_score, row_number() OVER (PARTITION BY slot ORDER BY
             (CAST(tp AS DOUBLE) - atp) * (CAST(bfp AS DOUBLE) - afp) - (CAST(fp AS DOUBLE) - afp) * (CAST(btp AS DOUBLE) - atp) DESC, score DESC) AS r
           FROM slots s JOIN ends USING (slot))
  SELECT score AS threshold, fp / n AS fpr, tp / p AS tpr FROM high WHERE r = 1 OR score IN (first_score, last_score)
  UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def m11_roc_bounded(spark, sf_dir):
    """ROC curve of at most 100 points whose area is within 1/66 of the full curve's."""
    return me.roc_points(scores(spark, sf_dir), MAX_POINTS)


@query("m12_pr_bounded", ["scores"], f"""
  WITH {_CURVE_SQL},
  slots AS (SELECT *, tp / (tp + fp) AS precision, least(floor(tp / p * {(MAX_POINTS - 1) // 4}), {(MAX_POINTS - 1) // 4 - 1}) AS slot FROM cells),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score) AS r1, row_number() OVER (PARTITION BY slot ORDER BY score DESC) AS r2,
                     row_number() OVER (PARTITION BY slot ORDER BY precision, score) AS r3,
                     row_number() OVER (PARTITION BY slot ORDER BY precision DESC, score DESC) AS r4 FROM slots)
  SELECT score AS threshold, precision, tp / p AS recall FROM ordered WHERE least(r1, r2, r3, r4) = 1
  UNION ALL SELECT CAST('inf' AS DOUBLE), 1.0, 0.0""")
def m12_pr_bounded(spark, sf_dir):
    """PR curve of at most 100 points that brackets the average precision."""
    return me.pr_points(scores(spark, sf_dir), MAX_POINTS)


@query("w4_stratified_folds", ["folds"], "SELECT key, label, fold FROM folds")
def w4_stratified_folds(spark, sf_dir):
    """Stratified 5-fold assignment by keyed-hash rank within label (no 2-task window)."""
    return folds(spark, sf_dir).select("key", "label", "fold")


@query("m_fold_metrics", ["folds"], f"""
  SELECT a.fold, roc_auc, average_precision, brier_score
  FROM ({auc_sql('folds', 'fold')}) a JOIN ({ap_sql('folds', 'fold')}) b USING (fold)
  JOIN ({brier_sql('folds', 'fold')}) c USING (fold)""")
def m_fold_metrics(spark, sf_dir):
    """L12 metrics part: AUC / AP / Brier per held-out fold in one grouped pass each."""
    f = folds(spark, sf_dir)
    return (me.roc_auc(f, ["fold"]).join(me.average_precision(f, ["fold"]), "fold")
              .join(me.brier(f, ["fold"]), "fold"))


@query("a18_cv_summary", ["folds"], f"""
  WITH fm AS (SELECT a.fold, roc_auc, average_precision, brier_score
              FROM ({auc_sql('folds', 'fold')}) a JOIN ({ap_sql('folds', 'fold', None)}) b USING (fold)
              JOIN ({brier_sql('folds', 'fold', None)}) c USING (fold)),
  lng AS (SELECT fold, 'roc_auc' AS metric, roc_auc AS value FROM fm
          UNION ALL SELECT fold, 'average_precision', average_precision FROM fm
          UNION ALL SELECT fold, 'brier_score', brier_score FROM fm)
  SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds
  FROM lng GROUP BY metric""")
def a18_cv_summary(spark, sf_dir):
    """Mean and population std of each metric over the folds."""
    f = folds(spark, sf_dir)
    fm = (me.roc_auc(f, ["fold"]).join(me.average_precision(f, ["fold"], digits=None), "fold")
            .join(me.brier(f, ["fold"], digits=None), "fold"))
    lng = fm.selectExpr("fold", "stack(3, 'roc_auc', roc_auc, 'average_precision', average_precision, "
                        "'brier_score', brier_score) AS (metric, value)")
    return me.metric_summary(lng, digits=6)


_EDGES_Q = exact_quantile_sql("scores", "score", me.quantile_fracs(10))
_BANDS_SQL = f"""
  WITH e0 AS (SELECT DISTINCT CASE WHEN q_idx = 0 THEN 0.0 WHEN q_idx = 10 THEN 1.0 ELSE value END AS e FROM {_EDGES_Q} q),
  eo AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS ne FROM e0),
  bins AS (SELECT a.i AS bin, a.e AS bin_lower, b.e AS bin_upper, a.ne - 2 AS last_bin FROM eo a JOIN eo b ON b.i = a.i + 1),
  asg AS (SELECT b.bin, s.label FROM scores s JOIN bins b
          ON s.score >= b.bin_lower AND (s.score < b.bin_upper OR (b.bin = b.last_bin AND s.score <= b.bin_upper))),
  cnt AS (SELECT bin, count(*) AS n, sum(label) AS successes FROM asg GROUP BY bin),
  bt AS (SELECT b.bin, b.bin_lower, b.bin_upper, coalesce(c.n, 0) AS n, CAST(coalesce(c.successes, 0) AS BIGINT) AS successes
         FROM bins b LEFT JOIN cnt c USING (bin)),
  wz AS (SELECT *, CASE WHEN n > 0 THEN successes / n ELSE 0.0 END AS phat,
                CAST(successes AS DOUBLE) / n AS p, 1.6448536269514722 AS z FROM bt)
  SELECT bin, bin_lower, bin_upper, n, successes, phat,
         CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, ((p + z*z / (2.0*n)) - z * sqrt(p*(1.0-p)/n + z*z/(4.0*n*n))) / (1.0 + z*z/n)), 9) END AS ci_lower,
         CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, ((p + z*z / (2.0*n)) + z * sqrt(p*(1.0-p)/n + z*z/(4.0*n*n))) / (1.0 + z*z/n)), 9) END AS ci_upper
  FROM wz"""


@query("u2_confidence_bands", ["scores"], _BANDS_SQL)
def u2_confidence_bands(spark, sf_dir):
    """U2 + U1: quantile band table with Wilson 90% intervals (empty bins kept)."""
    return un.confidence_bands(scores(spark, sf_dir))


@query("j3_band_lookup", ["scores"], f"""
  WITH bands AS ({_BANDS_SQL.replace('WITH ', '', 1).join(['(WITH ', ')'])}),
  tb AS (SELECT max(bin_upper) AS top FROM bands)
  SELECT s.key, s.score AS probability, b.ci_lower AS band_lower, b.ci_upper AS band_upper
  FROM scores s JOIN bands b ON b.bin_lower <= s.score
       AND (s.score < b.bin_upper OR (b.bin_upper = (SELECT top FROM tb) AND s.score <= b.bin_upper))""")
def j3_band_lookup(spark, sf_dir):
    """Per-request band lookup (broadcast range join against <= n_bins bands)."""
    s = scores(spark, sf_dir)
    bands = materialize(un.confidence_bands(s), "bands")
    req = s.select("key", F.col("score").alias("probability"))
    return un.lookup_band(req, bands)


@query("s7_ecdf_table", ["scores"], """
  SELECT score, n, sum(n) OVER (ORDER BY score) AS cum_n, sum(n) OVER () AS total
  FROM (SELECT score, count(*) AS n FROM scores GROUP BY score) c""")
def s7_ecdf_table(spark, sf_dir):
    """The compressed reference ECDF, saved as parquet and loaded again."""
    return un.ecdf_table(scores(spark, sf_dir))


def _wilson_sql(z: float) -> str:
    return _BANDS_SQL.replace("1.6448536269514722", repr(z))


@query("u1_wilson_95", ["scores"], _wilson_sql(1.959963984540054))
def u1_wilson_95(spark, sf_dir):
    """The band table with Wilson 95 % intervals."""
    return un.confidence_bands(scores(spark, sf_dir), confidence=0.95)


@query("u1_wilson_99", ["scores"], _wilson_sql(2.5758293035489004))
def u1_wilson_99(spark, sf_dir):
    """The band table with Wilson 99 % intervals."""
    return un.confidence_bands(scores(spark, sf_dir), confidence=0.99)


@query("w1_percentile", ["scores"], """
  SELECT s.key, s.score AS probability, 100.0 * c.n_le / (SELECT count(*) FROM scores) AS percentile
  FROM scores s JOIN (SELECT a.score, sum(b.n) AS n_le FROM (SELECT DISTINCT score FROM scores) a
                      JOIN (SELECT score, count(*) AS n FROM scores GROUP BY score) b ON b.score <= a.score
                      GROUP BY a.score) c ON c.score = s.score""")
def w1_percentile(spark, sf_dir):
    """Percentile of each score against the whole reference distribution (stored block index)."""
    s = scores(spark, sf_dir)
    req = s.select("key", F.col("score").alias("probability"))
    return un.percentile_of(req, s).select("key", "probability", "percentile")


@query("u5_bracket_summary", ["scores"], f"""
  WITH bands AS ({_BANDS_SQL.replace('WITH ', '', 1).join(['(WITH ', ')'])}),
  tb AS (SELECT max(bin_upper) AS top FROM bands),
  lk AS (SELECT s.key, s.score AS probability, b.ci_lower AS lo, b.ci_upper AS hi
         FROM scores s JOIN bands b ON b.bin_lower <= s.score
              AND (s.score < b.bin_upper OR (b.bin_upper = (SELECT top FROM tb) AND s.score <= b.bin_upper)))
  SELECT count(*) AS n, count_if(coalesce(lo <= probability AND probability <= hi, false)) AS n_bracketing FROM lk""")
def u5_bracket_summary(spark, sf_dir):
    """How many looked-up bands bracket their point (the raising form is the same with ``strict``)."""
    s = scores(spark, sf_dir)
    req = s.select("key", F.col("score").alias("probability"))
    return un.bracket_summary(un.lookup_band(req, materialize(un.confidence_bands(s), "bands")), strict=False)


@query("l18_sigmoid_calibration")
def l18_sigmoid_calibration(spark, sf_dir):
    """A sigmoid calibrator fitted on the scores, evaluated at every distinct score."""
    s = scores(spark, sf_dir)
    fitted = ca.fit_calibrator(s.select(F.col("score").alias("raw_score"), "label"), "sigmoid")
    return fitted.transform(s.select(F.col("score").alias("raw_score")).distinct()).select("raw_score", "probability")


@query("u4_score_cells", ["scores"], """
  SELECT score, count_if(label = 0) AS n0, count_if(label = 1) AS n1 FROM scores GROUP BY score""")
def u4_score_cells(spark, sf_dir):
    """U4: the score cells that bootstrap replicates are drawn from."""
    return ca.score_cells(scores(spark, sf_dir), "score", "label").select("score", F.col("n0").cast("bigint").alias("n0"), F.col("n1").cast("bigint").alias("n1"))


@query("s8_metadata_json", ["scores"], """
  SELECT CAST(score_key % 10 AS INTEGER) AS bucket, count(*) AS n, sum(label) AS successes FROM scores GROUP BY 1""")
def s8_metadata_json(spark, sf_dir):
    """Per-bucket metadata written as JSON text and read back with a schema (to_json / from_json)."""
    rows = scores(spark, sf_dir).groupBy((F.col("score_key") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("successes"))
    text = materialize(rows.select(F.to_json(F.struct("bucket", "n", "successes")).alias("metadata")), "metadata")
    return text.select(F.from_json("metadata", "bucket int, n bigint, successes bigint").alias("m")).select("m.*")


@query("u6_collapse_band", ["scores"], f"""
  WITH bands AS ({_BANDS_SQL.replace('WITH ', '', 1).join(['(WITH ', ')'])}),
  tb AS (SELECT max(bin_upper) AS top FROM bands),
  lk AS (SELECT s.key, s.score AS probability, b.ci_lower AS lo, b.ci_upper AS hi
         FROM scores s JOIN bands b ON b.bin_lower <= s.score
              AND (s.score < b.bin_upper OR (b.bin_upper = (SELECT top FROM tb) AND s.score <= b.bin_upper)))
  SELECT key, probability, coalesce(lo <= probability AND probability <= hi, false) AS brackets,
         CASE WHEN lo <= probability AND probability <= hi THEN lo ELSE probability END AS band_lower,
         CASE WHEN lo <= probability AND probability <= hi THEN hi ELSE probability END AS band_upper
  FROM lk""")
def u6_collapse_band(spark, sf_dir):
    """U5 flag + U6: bands that do not bracket the point collapse to it."""
    s = scores(spark, sf_dir)
    req = s.select("key", F.col("score").alias("probability"))
    return un.collapse_on_failure(un.lookup_band(req, materialize(un.confidence_bands(s), "bands")))
