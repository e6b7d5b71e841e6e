"""Per-row signed contributions (L21), sensitivity curves (L22) and grids.

Linear models: exact SHAP for independent features, coef * (x - mean(x)) in the
model's input space, summed over a categorical's one-hot slots.

Boosted trees: exact path-dependent tree SHAP, leaf by leaf. For every pattern of
path conditions (at most one per feature) that a row meets, the Shapley values of the leaf are precomputed on the driver
(2^d x d numbers per leaf, model-sized); a request batch in ``mapInPandas`` only tests the conditions and
looks its pattern up. Ranking by absolute value happens in the JVM.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.operators.modeling import FittedModel

# ------------------------------------------------------------------ trees

def tree_nodes(model: FittedModel) -> list[dict]:
    """The fitted trees as {node: prediction, cover, left, right, feature, threshold}; a leaf has the children -1."""
    out = []
    for t in model.ensemble.trees:
        leaf = t.left == np.arange(len(t.left))
        out.append({i: {"prediction": float(t.value[i]), "cover": float(t.cover[i]), "left": -1 if leaf[i] else int(t.left[i]), "right": -1 if leaf[i] else int(t.right[i]),
                        "feature": int(t.feature[i]), "threshold": None if leaf[i] else float(model.ensemble.edges[t.feature[i]][t.cut[i]])} for i in range(len(t.left))})
    return out


def _leaf_table(weight: float, tree: dict) -> list[tuple]:
    """For each leaf: its features, their (low, high] intervals, Shapley values by pattern of met intervals, and base value.

    The conditional expectation of a leaf given the features in S is its value times, per path feature,
    whether the row meets the feature's interval (in S) or the share of training cover that does (not in S).
    """
    out, todo = [], [(0, {})]
    while todo:
        nid, path = todo.pop()
        node = tree[nid]
        if node["left"] >= 0:
            f, cut, cover = int(node["feature"]), node["threshold"], tree[node["left"]]["cover"] + tree[node["right"]]["cover"]
            lo, hi, share = path.get(f, (-math.inf, math.inf, 1.0))
            todo.append((node["left"], path | {f: (lo, min(hi, cut), share * tree[node["left"]]["cover"] / cover)}))
            todo.append((node["right"], path | {f: (max(lo, cut), hi, share * tree[node["right"]]["cover"] / cover)}))
            continue
        value, feats = weight * node["prediction"], sorted(path)
        d = len(feats)
        share = [path[f][2] for f in feats]
        met = (np.arange(1 << d)[:, None] >> np.arange(d)[None, :]) & 1  # patterns x features
        weights = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
        phi = np.zeros((1 << d, d))
        for j in range(d):
            # poly[:, s]: sum over subsets of size s of met (inside) times share (outside), for every pattern
            poly = np.ones((1 << d, 1))
            for k in range(d):
                if k != j:
                    poly = np.pad(poly * share[k], ((0, 0), (0, 1))) + np.pad(poly * met[:, k : k + 1], ((0, 0), (1, 0)))
            phi[:, j] = value * (met[:, j] - share[j]) * (poly @ weights)
        out.append((feats, [path[f][:2] for f in feats], phi, value * math.prod(share), value))
    return out


def _tree_arrays(model: FittedModel) -> list[tuple]:
    return [leaf for tree in tree_nodes(model) for leaf in _leaf_table(1.0, tree)]


def _leaf_values(x: np.ndarray, leaves: list[tuple]) -> tuple[np.ndarray, np.ndarray, float]:
    """(Shapley values, ensemble value, base value) of the rows of x."""
    phi, total, base = np.zeros(x.shape), np.zeros(len(x)), 0.0
    for feats, intervals, table, mean, value in leaves:
        pattern = np.zeros(len(x), dtype=np.int64)
        for j, (f, (lo, hi)) in enumerate(zip(feats, intervals)):
            pattern |= ((x[:, f] > lo) & (x[:, f] <= hi)).astype(np.int64) << j
        if feats:
            phi[:, feats] += table[pattern]
        total += value * (pattern == (1 << len(feats)) - 1)
        base += mean
    return phi, total, base


def _ranked(names: list[str], values, raw: list, top_n: int):
    """The ``top_n`` contributions by absolute value, the earlier feature first on ties."""
    parts = [F.struct(F.lit(f).alias("feature"), raw[i].alias("value"), values[i].alias("shap_value"),
                      F.when(values[i] > 0, "increases").otherwise("decreases").alias("direction"), F.lit(i).alias("pos"))
             for i, f in enumerate(names)]
    order = F.array_sort(F.array(*parts), lambda a, b: F.when(F.abs(a["shap_value"]) > F.abs(b["shap_value"]), -1)
                         .when(F.abs(a["shap_value"]) < F.abs(b["shap_value"]), 1).otherwise(a["pos"] - b["pos"]))
    return F.transform(F.slice(order, 1, top_n), lambda c: F.struct(
        c["feature"].alias("feature"), c["value"].alias("value"), c["shap_value"].alias("shap_value"), c["direction"].alias("direction")))


def tree_contributions(model: FittedModel, requests: DataFrame, key: str, top_n: int = C.TOP_N_CONTRIBUTIONS) -> DataFrame:
    """L21 for boosted trees: (key, base_value, margin, contributions) in log-odds units."""
    names = model.spec.columns
    spark = requests.sparkSession
    bc = spark.sparkContext.broadcast(_tree_arrays(model))
    start = model.ensemble.base
    prepared = model.prepared(requests).select(
        F.col(key).alias("_key"), vector_to_array("features").alias("_x"),
        *[F.col(c).cast("string").alias(f"_raw_{i}") for i, c in enumerate(names)])
    raw_cols = [f"_raw_{i}" for i in range(len(names))]

    def run(it):
        leaves = bc.value
        for batch in it:
            if batch.empty:
                continue
            phi, total, base = _leaf_values(np.vstack(batch["_x"].to_numpy()), leaves)
            out = batch[["_key", *raw_cols]].copy()
            out["base_value"], out["margin"] = start + base, start + total  # probability = sigmoid(margin)
            out["_phi"] = list(phi)
            yield out

    schema = (f"_key {requests.schema[key].dataType.simpleString()}, " + "".join(f"{c} string, " for c in raw_cols)
              + "base_value double, margin double, _phi array<double>")
    out = prepared.mapInPandas(run, schema)
    ranked = _ranked(names, [F.col("_phi")[i] for i in range(len(names))], [F.col(c) for c in raw_cols], top_n)
    return out.select(F.col("_key").alias(key), "base_value", "margin", ranked.alias("contributions"))


# ------------------------------------------------------------------ linear

def linear_contributions(model: FittedModel, requests: DataFrame, train: DataFrame, key: str,
                         top_n: int = C.TOP_N_CONTRIBUTIONS) -> DataFrame:
    """L21 for logistic regression: coef * (x - mean_train(x)), one value per input feature (exact)."""
    names = model.spec.columns
    lr = model.pipeline.stages[-1]
    coef = lr.coefficients.toArray().tolist()
    mean = model.prepared(train).select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray().tolist()
    places: dict[str, list[int]] = {}
    for i, f in enumerate(_slot_features(model)):
        places.setdefault(f, []).append(i)
    # per feature one dot product over its slots; coefficients and means are literal arrays of the model
    prepared = model.prepared(requests).select(F.col(key), vector_to_array("features").alias("_x"),
                                               *[F.col(c).cast("string").alias(f"_raw_{c}") for c in names])
    values = []
    for f in names:
        slots = places.get(f, [])
        first = slots[0] if slots else 0
        own = F.array(*[F.lit(coef[i]) for i in slots]) if slots else F.array().cast("array<double>")
        offset = F.lit(float(sum(coef[i] * mean[i] for i in slots)))
        dot = F.aggregate(F.zip_with(F.slice("_x", first + 1, max(len(slots), 0)), own, lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
        values.append(dot - offset)
    return prepared.select(key, _ranked(names, values, [F.col(f"_raw_{f}") for f in names], top_n).alias("contributions"))


def _slot_features(model: FittedModel) -> list[str]:
    """Map each assembled vector slot back to its input feature."""
    spec = model.spec
    slots = list(spec.numeric)
    idx_model = model.pipeline.stages[1]
    for c, labels in zip(spec.categorical, idx_model.labelsArray):
        slots += [c] * (len(labels) if spec.encoding == "onehot" else 1)
    return slots


# ------------------------------------------------------------------ sensitivity

def numeric_grid(ranges: DataFrame, feature: str, n_points: int = C.PDP_GRID_POINTS,
                 floor: float | None = None) -> DataFrame:
    """N points from p01 to p99 (numpy linspace arithmetic), optionally floored at the start."""
    r = ranges.where(F.col("feature") == feature)
    lo = F.col("p01") if floor is None else F.greatest(F.col("p01"), F.lit(float(floor)))
    step = (F.col("p99") - lo) / F.lit(float(n_points - 1))
    g = r.select(lo.alias("_lo"), F.col("p99").alias("_hi"), step.alias("_step"),
                 F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i"))
    return g.select(F.lit(feature).alias("feature"), "i",
                    F.when(F.col("i") == n_points - 1, F.col("_hi"))
                    .otherwise(F.col("i").cast("double") * F.col("_step") + F.col("_lo")).alias("grid_value"))


def category_grid(train: DataFrame, cols: list[str], top_n: int = C.PDP_TOP_CATEGORIES) -> DataFrame:
    """The ``top_n`` most frequent values per categorical feature (a top-k report), ties by value."""
    stacked = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = train.selectExpr(f"stack({len(cols)}, {stacked}) AS (feature, value)").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("i", F.row_number().over(w) - 1).where(F.col("i") < top_n)


def sensitivity(model: FittedModel, base_rows: DataFrame, key: str, feature: str, grid: DataFrame,
                calibrator=None) -> DataFrame:
    """L22 + J10: each base row repeated over the (<= 30 point) grid with one feature replaced.

    The grid is a constant-size broadcast, so the expansion is rows x 30.
    Returns (key, grid_value, predicted_probability); grouping by grid_value gives
    the population partial dependence.
    """
    if model.ensemble is not None and feature in model.spec.numeric:
        return _ensemble_curves(model, base_rows, key, feature, grid, calibrator)
    g = F.broadcast(grid.select("grid_value"))
    dtype = base_rows.schema[feature].dataType
    expanded = base_rows.crossJoin(g).withColumn(feature, F.col("grid_value").cast(dtype))
    scored = model.transform(expanded)
    return _calibrated(scored, calibrator).select(key, "grid_value", F.col("score").alias("predicted_probability"))


def _calibrated(scored: DataFrame, calibrator) -> DataFrame:
    return scored if calibrator is None else calibrator.transform(scored.withColumnRenamed("score", "raw_score"), "raw_score", "score")


def _ensemble_curves(model: FittedModel, base_rows: DataFrame, key: str, feature: str, grid: DataFrame, calibrator) -> DataFrame:
    """``sensitivity`` of boosted trees to a numeric feature: rows are prepared once and walk the trees once, for all grid points together.

    Trees see the bin of a grid point only, so every row is scored and calibrated for the grid's bins and then repeated over the points.
    """
    kind, place, ensemble = base_rows.schema[feature].dataType, model.spec.columns.index(feature), model.ensemble
    known = F.coalesce(F.col("grid_value").cast(kind).cast("double"), F.lit(float(model.medians[feature])))
    points = grid.select("grid_value", known.alias("x")).collect()  # one row per grid point
    bins, at = np.unique(np.searchsorted(ensemble.edges[place], [p["x"] for p in points], side="left"), return_inverse=True)
    prepared = model.prepared(base_rows.withColumn(feature, F.lit(None).cast(kind))).select(F.col(key).alias("_key"), vector_to_array("features").alias("_x"))
    width = len(model.spec.columns)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                raw = ensemble.curves(batch.column(1).flatten().to_numpy().reshape(n, width), place, bins)
                score = pa.array((1 / (1 + np.exp(-raw))).T.ravel())
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(bins)), score)], ["_key", "_scores"])

    if not points:
        return base_rows.limit(0).select(key, F.lit(None).cast(grid.schema["grid_value"].dataType).alias("grid_value"), F.lit(None).cast("double").alias("predicted_probability"))
    scores = prepared.mapInArrow(run, f"_key {base_rows.schema[key].dataType.simpleString()}, _scores array<double>").select("_key", F.posexplode("_scores").alias("_bin", "score"))
    of_bin = F.array(*[F.array(*[F.lit(p["grid_value"]).cast(grid.schema["grid_value"].dataType) for p, b in zip(points, at) if b == k]) for k in range(len(bins))])
    return _calibrated(scores, calibrator).select(F.col("_key").alias(key), F.explode(F.get(of_bin, F.col("_bin"))).alias("grid_value"), F.col("score").alias("predicted_probability"))


def numeric_ranges(train: DataFrame, cols: list[str]) -> DataFrame:
    """A10: min, max, p01, p99 per numeric feature (exact quantiles via distributed ranks)."""
    from cohortlab.operators.prefix import exact_quantiles
    stacked = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = train.selectExpr(f"stack({len(cols)}, {stacked}) AS (feature, value)").where(F.col("value").isNotNull())
    q = exact_quantiles(long, "value", [0.01, 0.99], ["feature"])
    p = q.groupBy("feature").agg(F.max(F.when(F.col("q_idx") == 0, F.col("value"))).alias("p01"),
                                 F.max(F.when(F.col("q_idx") == 1, F.col("value"))).alias("p99"))
    mm = long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return mm.join(p, "feature")
