"""Calibration and bootstrap bands.

Isotonic calibration is Spark ML's IsotonicRegression (pool-adjacent-violators,
linear interpolation, clamped at the ends); sigmoid calibration is a one-feature
logistic regression. The bootstrap first compresses the calibration rows to score cells (counts of
both labels), draws every replicate's n rows with replacement by a multinomial splitting tree over the cells (or Poisson counts
per cell), and refits the model's own calibrator per replicate. Isotonic refits pool adjacent violators within fixed score ranges first and
then across the ranges' pooled steps (pooling is associative), so no task holds all distinct scores of
a replicate; a sigmoid refit (chosen below 1,000 rows only) is a weighted logistic fit of the cells. The
result is one small step function or (slope, intercept) per replicate.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab import constants as C
from cohortlab.operators.prefix import ranks
from cohortlab.session import materialize


class Calibrator:
    """Maps a raw score column to a calibrated probability."""

    def __init__(self, method: str, model):
        self.method, self.model = method, model

    def transform(self, df: DataFrame, raw_col: str = "raw_score", out_col: str = "probability") -> DataFrame:
        if self.method == "isotonic":
            out = self.model.transform(df.withColumn("_x", F.col(raw_col)))
            return out.withColumnRenamed("prediction", out_col).drop("_x")
        va = VectorAssembler(inputCols=[raw_col], outputCol="_xv")
        out = self.model.transform(va.transform(df))
        return (out.withColumn(out_col, vector_to_array(F.col("probability"))[1])
                   .drop("_xv", "rawPrediction", "prediction", "probability")
                   if out_col != "probability" else
                   out.withColumn("_p", vector_to_array(F.col("probability"))[1])
                      .drop("_xv", "rawPrediction", "prediction", "probability").withColumnRenamed("_p", out_col))


def fit_calibrator(cal: DataFrame, method: str, raw_col: str = "raw_score", label_col: str = "label") -> Calibrator:
    """L17 / L18."""
    if method == "isotonic":
        iso = IsotonicRegression(featuresCol="_x", labelCol=label_col, predictionCol="prediction", isotonic=True)
        return Calibrator("isotonic", iso.fit(cal.select(F.col(raw_col).alias("_x"),
                                                         F.col(label_col).cast("double").alias(label_col))))
    if method == "sigmoid":
        n = cal.count()
        va = VectorAssembler(inputCols=[raw_col], outputCol="_xv")
        lr = LogisticRegression(featuresCol="_xv", labelCol=label_col, regParam=1.0 / max(n, 1),
                                elasticNetParam=0.0, standardization=False)
        return Calibrator("sigmoid", lr.fit(va.transform(cal.withColumn(label_col, F.col(label_col).cast("double")))))
    raise ValueError(f"unknown calibration method: {method}")


# ------------------------------------------------------------------ bootstrap (U4)

# Poisson(1) cumulative probabilities P(X <= k), k = 0..9
_POISSON1_CDF = [math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(k + 1)) for k in range(10)]
#: Ranges of [0, 1] whose cells are pooled first, groups of replicates that share such a task, and children of a node of the splitting tree.
RANGES, REPLICATE_GROUPS, FAN = 16, 8, 1024


def poisson_weight(u: Column) -> Column:
    """Inverse CDF of Poisson(1) for a uniform u in [0, 1)."""
    expr = F.when(u < _POISSON1_CDF[0], F.lit(0))
    for k in range(1, len(_POISSON1_CDF)):
        expr = expr.when(u < _POISSON1_CDF[k], F.lit(k))
    return expr.otherwise(F.lit(len(_POISSON1_CDF)))


def poisson_draw(u: Column, n: Column) -> Column:
    """Poisson(n) for a count n: the CASE above for 1, else an inverse transform over 9 standard deviations."""
    lam = n.cast("double")
    lo = F.greatest(F.lit(0.0), F.floor(lam - 9 * F.sqrt(lam) - 9).cast("double")).cast("long")
    hi = F.ceil(lam + 9 * F.sqrt(lam) + 12).cast("long")
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(lo, hi), start, lambda s, x: F.struct((s["w"] * lam / (x + 1)).alias("w"), (s["sum"] + s["w"]).alias("sum")))["sum"]
    seek = F.struct(F.lit(1.0).alias("w"), (u * total).alias("left"), lo.alias("x"))
    found = F.aggregate(F.sequence(lo, hi), seek, lambda s, x: F.struct(
        (s["w"] * lam / (x + 1)).alias("w"), (s["left"] - s["w"]).alias("left"),
        F.when((s["left"] > s["w"]) & (x < hi), x + 1).otherwise(s["x"]).alias("x")))["x"]
    return F.when(n == 0, F.lit(0)).when(n == 1, poisson_weight(u)).otherwise(found).cast("double")


def score_cells(cal: DataFrame, raw_col: str = "raw_score", label_col: str = "label") -> DataFrame:
    """(score, n0, n1): rows of either label per distinct score."""
    y = F.col(label_col).cast("int")
    return cal.groupBy(F.col(raw_col).cast("double").alias("score")).agg(
        F.sum(F.when(y == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(y == 1, 1).otherwise(0)).alias("n1"))


def bootstrap_cells(cal: DataFrame, n_bootstrap: int = C.N_BOOTSTRAP, seed: int = 42,
                    raw_col: str = "raw_score", label_col: str = "label", mode: str = "exact") -> DataFrame:
    """(replicate, score, w, wpos): resampled counts of every score cell and replicate.

    ``exact`` draws n of the n rows with replacement (``multinomial_cells``); ``poisson`` draws each cell on its own, so that
    a replicate has n rows on average.
    """
    cells = score_cells(cal, raw_col, label_col)
    if mode == "exact":
        return multinomial_cells(cells, n_bootstrap, seed)
    rep = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))))
    u = lambda label: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "score", "replicate", F.lit(label)), 11) / F.lit(float(1 << 53))
    drawn = rep.withColumns({"_w0": poisson_draw(u(0), F.col("n0")), "wpos": poisson_draw(u(1), F.col("n1"))})
    return drawn.select("replicate", "score", (F.col("_w0") + F.col("wpos")).alias("w"), "wpos").where("w > 0")


def multinomial_cells(cells: DataFrame, n_bootstrap: int, seed: int, fan: int = FAN) -> DataFrame:
    """Multinomial counts of (score, n0, n1) cells by a splitting tree: every replicate has exactly as many rows as the cells.

    Cells are numbered by score and label. A node of the tree holds a range of cells and a replicate's number of draws in it; it deals
    them to at most ``fan`` children by a multinomial draw (conditional binomials) on the children's row counts, until a child is one cell.
    Draws are keyed by seed, level, replicate and node, so reruns and retries agree.
    """
    spark = cells.sparkSession
    long = cells.select("score", F.explode(F.array(F.struct(F.lit(0).alias("label"), F.col("n0").cast("long").alias("n")), F.struct(F.lit(1).alias("label"), F.col("n1").cast("long").alias("n")))).alias("c"))
    long = ranks(long.select("score", "c.label", "c.n").where("n > 0"), "score", tie_cols=["label"])
    long = materialize(long.select("score", "label", "n", (F.col("rank") - 1).cast("long").alias("id")), "bootstrap-cells")
    m, total = long.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    levels = 1
    while fan**levels < m:
        levels += 1
    draws = spark.range(n_bootstrap).select(F.col("id").cast("int").alias("replicate"), F.lit(0).cast("long").alias("node"), F.lit(total).cast("long").alias("n"))
    for level in range(1, levels + 1):
        child = long.groupBy(F.floor(F.col("id") / fan ** (levels - level)).cast("long").alias("child")).agg(F.sum("n").alias("rows"))
        kids = child.groupBy(F.floor(F.col("child") / fan).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "rows"))).alias("kids"))  # at most fan
        joined = draws.join(kids, "node").select("replicate", "node", "n", F.transform("kids", lambda k: k["child"]).alias("child"), F.transform("kids", lambda k: k["rows"]).alias("rows"))
        draws = joined.mapInArrow(_dealt(seed, level), "replicate int, node long, n long")
    leaf = draws.join(long.select(F.col("id").alias("node"), "score", "label"), "node")
    return leaf.groupBy("replicate", "score").agg(F.sum("n").cast("double").alias("w"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("wpos"))


def _dealt(seed: int, level: int):
    """Deals each row's n draws to its children, in proportion to their rows."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = np.array(r["rows"], dtype=float)
                rng = np.random.Generator(np.random.Philox(key=np.array([(seed << 8) + level, (r["replicate"] << 40) ^ r["node"]], dtype=np.uint64)))
                got = rng.multinomial(r["n"], rows / rows.sum())
                at = np.flatnonzero(got)
                yield pa.record_batch([pa.array(np.full(len(at), r["replicate"], dtype=np.int32)), pa.array(np.array(r["child"], dtype=np.int64)[at]), pa.array(got[at])], ["replicate", "node", "n"])

    return run


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, wpos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weighted pool-adjacent-violators of ordered steps: (lo, hi, w, wpos) of the pooled steps."""
    out: list[list[float]] = []
    for step in zip(lo, hi, w, wpos):
        out.append(list(step))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, h, a, b = out.pop()
            out[-1][1] = h
            out[-1][2] += a
            out[-1][3] += b
    return tuple(np.array(c, dtype=float) for c in zip(*out)) if out else (np.empty(0),) * 4


def _pool_replicates(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for replicate, g in pdf.sort_values("lo").groupby("replicate"):
        lo, hi, w, wpos = pool(*(g[c].to_numpy() for c in ("lo", "hi", "w", "wpos")))
        parts.append(pd.DataFrame({"replicate": replicate, "lo": lo, "hi": hi, "w": w, "wpos": wpos}))
    return pd.concat(parts)


def sigmoid_fit(x: np.ndarray, w: np.ndarray, wpos: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the logistic fit with penalty slope**2 / 2 on the summed loss, by Newton steps."""
    a, b = 0.0, math.log((wpos.sum() + 0.5) / (w.sum() - wpos.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, v = w * p - wpos, w * p * (1 - p)
        g = np.array([(r * x).sum() + a, r.sum()])
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-12]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


def _fit_sigmoids(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(r, *sigmoid_fit(*(g[c].to_numpy() for c in ("score", "w", "wpos")))) for r, g in pdf.sort_values("score").groupby("replicate")]
    return pd.DataFrame(rows, columns=["replicate", "x", "y"])


def bootstrap_curves(cells: DataFrame, method: str = "isotonic") -> DataFrame:
    """One refit per replicate: (replicate, x, y) are the ends of isotonic steps, or a sigmoid's slope and intercept."""
    group = F.col("replicate") % REPLICATE_GROUPS
    if method == "sigmoid":
        return cells.groupBy("replicate").applyInPandas(_fit_sigmoids, "replicate int, x double, y double")
    steps = "replicate int, lo double, hi double, w double, wpos double"
    own = cells.select("replicate", F.col("score").alias("lo"), F.col("score").alias("hi"), "w", "wpos", F.floor(F.col("score") * RANGES).alias("_range"))
    first = own.groupBy("_range", group).applyInPandas(lambda pdf: _pool_replicates(pdf), steps)
    whole = first.groupBy("replicate").applyInPandas(lambda pdf: _pool_replicates(pdf), steps)
    mean = F.col("wpos") / F.col("w")
    ends = F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    return whole.select("replicate", F.explode(ends).alias("x"), mean.alias("y"))


def bootstrap_band(requests: DataFrame, curves: DataFrame, raw_col: str = "raw_score",
                   confidence: float = C.BOOTSTRAP_CONFIDENCE, method: str = "isotonic") -> DataFrame:
    """U4: 5 / 95 % quantiles over replicates of each request's calibrated raw score.

    The curves are the model: per replicate the pooled steps (far fewer than distinct scores, as
    pooled means rise strictly), or two numbers. They are read once; requests stay distributed.
    """
    spark = requests.sparkSession
    pdf = curves.toPandas().sort_values(["replicate", "x"])
    reps = [(g["x"].to_numpy(), g["y"].to_numpy()) for _, g in pdf.groupby("replicate")]
    bc = spark.sparkContext.broadcast(reps)
    alpha = 1.0 - confidence
    cols = requests.columns

    def run(it):
        for batch in it:
            r = batch[raw_col].to_numpy(dtype=float)
            preds = np.vstack([np.interp(r, x, y) if method == "isotonic" else 1 / (1 + np.exp(-(x[0] * r + y[0]))) for x, y in bc.value])
            batch = batch.copy()
            batch["band_lower"] = np.quantile(preds, alpha / 2, axis=0)
            batch["band_upper"] = np.quantile(preds, 1 - alpha / 2, axis=0)
            yield batch

    schema = T.StructType(list(requests.schema.fields) + [T.StructField("band_lower", T.DoubleType()),
                                                          T.StructField("band_upper", T.DoubleType())])
    return requests.mapInPandas(run, schema).select(*cols, "band_lower", "band_upper")
