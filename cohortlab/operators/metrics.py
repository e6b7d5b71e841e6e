"""Evaluation metrics over a (label, score) DataFrame: M1-M12, W2, K5.

Every metric first compresses rows to score cells (one row per distinct score and
group), so later scans are bounded by distinct scores, not rows. Counts are kept
as integers until the final division, which makes AUC and the threshold statistics
exact and engine-independent.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.operators.prefix import exact_quantiles, running_sums
from cohortlab.session import materialize


BRIER_DIGITS = 10


def _rnd(c, digits):
    return c if digits is None else F.round(c, digits)


def score_cells(scored: DataFrame, group_cols: list[str] | None = None, score_col: str = "score",
                label_col: str = "label") -> DataFrame:
    """(group..., score, pos, neg, n) per distinct score: a map-side combined aggregate. Cells stay as they are."""
    g = list(group_cols or [])
    if {"pos", "neg", "n"} <= set(scored.columns):
        return scored
    lab = F.col(label_col).cast("bigint")
    return scored.groupBy(*g, F.col(score_col).cast("double").alias("score")).agg(
        F.sum(lab).alias("pos"), F.sum(F.lit(1) - lab).alias("neg"), F.count(F.lit(1)).alias("n"))


def roc_auc(scored: DataFrame, group_cols: list[str] | None = None, **kw) -> DataFrame:
    """M1: ROC AUC with ties counted half: sum_pos * (neg below + neg/2) / (P * N)."""
    g = list(group_cols or [])
    cells = running_sums(score_cells(scored, g, **kw), "score", ["neg"], g)
    num2 = F.col("pos") * (F.lit(2) * (F.col("cum_neg") - F.col("neg")) + F.col("neg"))
    return cells.groupBy(*g).agg(
        (F.sum(num2).cast("double") / (F.lit(2.0) * F.sum("pos").cast("double") * F.sum("neg").cast("double")))
        .alias("roc_auc"))


def average_precision(scored: DataFrame, group_cols: list[str] | None = None, digits: int = 9, **kw) -> DataFrame:
    """M2: step-wise AP (no interpolation): sum over thresholds of dRecall * precision."""
    g = list(group_cols or [])
    cells = running_sums(score_cells(scored, g, **kw), "score", ["pos", "neg"], g, descending=True)
    term = F.col("pos").cast("double") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return cells.groupBy(*g).agg(_rnd(F.sum(term) / F.sum("pos"), digits).alias("average_precision"))


def brier(scored: DataFrame, group_cols: list[str] | None = None, digits: int = BRIER_DIGITS,
          score_col: str = "score", label_col: str = "label") -> DataFrame:
    """M3: mean squared error of the probability.

    Rounded to 10 digits: with scores on a grid of thousandths and up to 10,000 rows the exact mean has no more, so
    engines that sum in different orders never round apart.
    """
    g = list(group_cols or [])
    d = F.col(score_col).cast("double") - F.col(label_col).cast("double")
    return scored.groupBy(*g).agg(_rnd(F.avg(d * d), digits).alias("brier_score"))


def _fbeta(tp, fp, fn, beta: float):
    b2 = beta * beta
    den = (1 + b2) * tp + b2 * fn + fp
    return F.when(tp == 0, F.lit(0.0)).otherwise(((1 + b2) * tp).cast("double") / den.cast("double"))


def confusion_at(scored: DataFrame, threshold: float, group_cols: list[str] | None = None,
                 score_col: str = "score", label_col: str = "label") -> DataFrame:
    """M4-M6: confusion matrix at ``score >= t`` plus precision / recall / F1 / F0.5 / rate / n."""
    g = list(group_cols or [])
    pred = F.col(score_col) >= F.lit(threshold)
    lab = F.col(label_col) == 1
    agg = scored.groupBy(*g).agg(
        F.count_if(~pred & ~lab).alias("tn"), F.count_if(pred & ~lab).alias("fp"),
        F.count_if(~pred & lab).alias("fn"), F.count_if(pred & lab).alias("tp"),
        F.avg(F.col(label_col).cast("double")).alias("positive_rate"), F.count(F.lit(1)).alias("n"))
    return agg.select(*g, *_confusion_columns(threshold), "positive_rate", "n")


def _confusion_columns(threshold: float) -> list:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [F.lit(float(threshold)).alias("threshold"), F.col("tn"), fp, fn, tp,
            F.when(tp + fp == 0, F.lit(0.0)).otherwise(tp / (tp + fp)).alias("precision"),
            F.when(tp + fn == 0, F.lit(0.0)).otherwise(tp / (tp + fn)).alias("recall"),
            _fbeta(tp, fp, fn, 1.0).alias("f1"), _fbeta(tp, fp, fn, 0.5).alias("f0_5")]


def compute_metrics(scored: DataFrame, threshold: float, group_cols: list[str] | None = None) -> DataFrame:
    """M7: the metric bundle as one row per group."""
    g = list(group_cols or [])
    # one pass over the rows: everything follows from the counts of both labels per distinct score
    cells = materialize(score_cells(scored, g), "score-cells")
    s, t = F.col("score"), F.lit(float(threshold))
    part = cells.groupBy(*g).agg(
        F.sum(F.when(s < t, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(s >= t, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(s < t, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(s >= t, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum("pos").alias("_p"), F.sum("n").alias("n"),
        F.sum(F.col("pos") * (s - 1) * (s - 1) + F.col("neg") * s * s).alias("_se"))
    out = part.select(*g, *_confusion_columns(threshold), (F.col("_p") / F.col("n")).alias("positive_rate"), "n", _rnd(F.col("_se") / F.col("n"), BRIER_DIGITS).alias("brier_score"))
    for more in (roc_auc(cells, g), average_precision(cells, g)):
        out = out.crossJoin(more) if not g else out.join(more, g)
    return out


def threshold_candidates(n: int = C.N_THRESHOLD_CANDIDATES) -> list[float]:
    """The candidate grid 0.01 .. 0.99 exactly as numpy's linspace produces it."""
    return [float(x) for x in np.linspace(0.01, 0.99, n)]


def threshold_table(scored: DataFrame, beta: float = C.THRESHOLD_BETA, group_cols: list[str] | None = None,
                    score_col: str = "score", label_col: str = "label") -> DataFrame:
    """F-beta at every candidate threshold from <= 100 bucket cells, one pass over the data.

    bucket = number of candidates <= score, so "score >= t_j" <=> bucket >= j.
    """
    g = list(group_cols or [])
    cands = threshold_candidates()
    arr = F.array(*[F.lit(c) for c in cands])
    s = F.col(score_col).cast("double")
    lab = F.col(label_col).cast("bigint")
    cells = (scored.select(*g, F.size(F.filter(arr, lambda t: t <= s)).alias("bucket"), lab.alias("lab"))
                   .groupBy(*g, "bucket").agg(F.sum("lab").alias("pos"), F.sum(F.lit(1) - F.col("lab")).alias("neg")))
    spark = scored.sparkSession
    # dense grid: every group gets buckets 0..99 (bounded: groups x 100 rows)
    grid = spark.createDataFrame([(b, cands[b - 1] if b > 0 else None) for b in range(len(cands) + 1)],
                                 "bucket int, threshold double")
    groups = cells.select(*g).distinct() if g else None
    base = groups.crossJoin(F.broadcast(grid)) if g else grid
    dense = base.join(cells, g + ["bucket"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy(*g).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wt = Window.partitionBy(*g)
    per = dense.select(*g, "bucket", "threshold", F.sum("pos").over(w).alias("tp"),
                       F.sum("neg").over(w).alias("fp"), F.sum("pos").over(wt).alias("P"))
    return per.where(F.col("bucket") >= 1).select(
        *g, "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
        _fbeta(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"), beta).alias("f_beta"))


def choose_threshold(scored: DataFrame, beta: float = C.THRESHOLD_BETA, group_cols: list[str] | None = None,
                     **kw) -> DataFrame:
    """M8 + K5: the candidate with the highest F-beta; the first (smallest) wins ties."""
    g = list(group_cols or [])
    tab = threshold_table(scored, beta, g, **kw)
    w = Window.partitionBy(*g).orderBy(F.col("f_beta").desc(), F.col("threshold").asc())
    return (tab.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
               .select(*g, "threshold", F.col("f_beta").alias("best_f_beta")))


def quantile_fracs(n_bins: int) -> list[float]:
    return [float(x) for x in np.linspace(0, 1, n_bins + 1)]


def reliability_curve(scored: DataFrame, n_bins: int = C.N_CALIBRATION_BINS, digits: int = 9,
                      score_col: str = "score", label_col: str = "label") -> DataFrame:
    """M9: quantile bins, bin = number of inner edges strictly below the score; empty bins dropped."""
    fr = quantile_fracs(n_bins)
    edges = exact_quantiles(scored, score_col, fr[1:-1])
    inner = edges.agg(F.array_sort(F.collect_list(F.struct("q_idx", "value"))).alias("_e")) \
                 .select(F.transform("_e", lambda x: x["value"]).alias("_inner"))  # n_bins - 1 values
    s = F.col(score_col).cast("double")
    b = scored.crossJoin(F.broadcast(inner)).select(
        F.size(F.filter("_inner", lambda e: e < s)).alias("bin"), s.alias("s"), F.col(label_col).cast("double").alias("y"))
    return b.groupBy("bin").agg(
        F.round(F.avg("s"), min(digits, 6)).alias("mean_predicted"),
        F.avg("y").alias("fraction_positive"), F.count(F.lit(1)).alias("n"))


def _curve_cells(scored: DataFrame) -> DataFrame:
    """(score, tp, fp, P, N) per distinct score: the counts at or above it, and all positives and negatives."""
    cells = running_sums(score_cells(scored), "score", ["pos", "neg"], descending=True)
    tot = cells.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cells.select("score", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp")).crossJoin(F.broadcast(tot))


def _kept_per_slot(points: DataFrame, extremes) -> DataFrame:
    """Distinct points of ``points`` (with ``slot``) that one of ``extremes``, aggregates of structs, picks in a slot."""
    picked = points.groupBy("slot").agg(F.array(*extremes).alias("_kept"))
    return picked.select("slot", F.explode("_kept").alias("_p")).select("slot", "_p.*").distinct()


def roc_points(scored: DataFrame, max_points: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, descending, plus the origin.

    ``max_points`` (at least 4) bounds the points: the curve is cut into m = (max_points - 1) // 3 slots of equal fpr + tpr, and a
    slot keeps its first and last point and the one farthest above the line between them. Between slots the curve is kept; within one
    both it and the kept points rise inside a box of width + height <= 2 / m, so the trapezoid area differs by 1 / (2 m) at most.
    """
    cells = _curve_cells(scored)
    if max_points is not None:
        cells = _thin_roc(cells, max_points)
    pts = cells.select(F.col("score").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))
    origin = scored.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(origin)


def _thin_roc(cells: DataFrame, max_points: int) -> DataFrame:
    if max_points < 4:
        raise ValueError("max_points must be at least 4")
    m = (max_points - 1) // 3
    along = (F.col("fp") / F.col("N") + F.col("tp") / F.col("P")) / 2
    cells = materialize(cells.withColumn("slot", F.least(F.floor(along * m), F.lit(m - 1))), "roc-cells")  # read for the ends and for the peaks
    point = F.struct("score", "tp", "fp", "P", "N")
    ends = cells.groupBy("slot").agg(F.max_by(F.struct("tp", "fp"), "score").alias("a"), F.min_by(F.struct("tp", "fp"), "score").alias("b"))  # m rows
    x = lambda c: F.col(c).cast("double")
    above = (x("tp") - x("a.tp")) * (x("b.fp") - x("a.fp")) - (x("fp") - x("a.fp")) * (x("b.tp") - x("a.tp"))
    height = cells.join(F.broadcast(ends), "slot").select("slot", "score", "tp", "fp", "P", "N", above.alias("above"))
    return _kept_per_slot(height, [F.max_by(point, "score"), F.min_by(point, "score"), F.max_by(point, F.struct("above", "score"))])


def pr_points(scored: DataFrame, max_points: int | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the (recall 0, precision 1) end.

    ``max_points`` (at least 5) bounds the points: m = (max_points - 1) // 4 slots of equal recall keep their first and last point and
    those of the lowest and highest precision. Any step area over the full curve lies between those of the slots' lowest and
    highest precisions, which the kept points give.
    """
    cells = _curve_cells(scored).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    if max_points is not None:
        if max_points < 5:
            raise ValueError("max_points must be at least 5")
        m = (max_points - 1) // 4
        slot = F.least(F.floor(F.col("tp") / F.col("P") * m), F.lit(m - 1))
        point = F.struct("score", "tp", "P", "precision")
        cells = _kept_per_slot(cells.withColumn("slot", slot), [
            F.max_by(point, "score"), F.min_by(point, "score"),
            F.max_by(point, F.struct("precision", "score")), F.min_by(point, F.struct("precision", "score"))])
    pts = cells.select(F.col("score").alias("threshold"), "precision", (F.col("tp") / F.col("P")).alias("recall"))
    end = scored.sparkSession.createDataFrame([(float("inf"), 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def metric_summary(fold_metrics: DataFrame, group_cols: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Mean and population std per metric over a (fold, metric, value) table."""
    g = list(group_cols or [])
    return fold_metrics.groupBy(*g, "metric").agg(
        F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_pop("value"), digits).alias("std"),
        F.count(F.lit(1)).alias("n_folds"))
