"""Batched learners: boosted trees against a plain best-first learner, logistic fits against single ones."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import boosting as bo
from cohortlab.operators import modeling as mo
from cohortlab.plans.q_etl import features_of


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 9, n), rng.random(n), rng.integers(0, 3, n)], axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] > 4) - 2 * x[:, 2] * (x[:, 3] == 1))))).astype(int)
    folds = rng.integers(0, 3, (n, 2))
    return x, y, folds


def frame(spark, x, y, folds, parts=1):
    rows = [(i, int(y[i]), [float(v) for v in x[i]], [int(f) for f in folds[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "key long, label int, x array<double>, folds array<int>").repartition(parts)


def plain_tree(x, y, raw, features, edges):
    """One best-first tree by direct search over every cut of every leaf: {path: (feature, cut)} and leaf values by row."""
    p = 1 / (1 + np.exp(-raw))
    g, h = np.rint((p - y) * bo.UNIT), np.rint(p * (1 - p) * bo.UNIT)

    def best(rows):
        top = (0.0, None, None)
        for f in features:
            for c in range(len(edges[f])):
                left = x[rows, f] <= edges[f][c]
                a, b = rows[left], rows[~left]
                if min(len(a), len(b)) < bo.LEAF_ROWS or min(h[a].sum(), h[b].sum()) < bo.LEAF_HESSIAN * bo.UNIT:
                    continue
                gain = (g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum()) / bo.UNIT
                if gain > top[0]:
                    top = (gain, f, c)
        return top

    leaves = {"": np.arange(len(x))}
    found, splits = {"": best(leaves[""])}, {}
    while len(leaves) < bo.LEAVES:
        path = max(found, key=lambda k: found[k][0])
        gain, f, c = found[path]
        if gain <= 0:
            break
        rows = leaves.pop(path)
        del found[path]
        splits[path] = (f, c)
        left = x[rows, f] <= edges[f][c]
        for side, part in (("L", rows[left]), ("R", rows[~left])):
            leaves[path + side] = part
            found[path + side] = best(part)
    value = np.zeros(len(x))
    for rows in leaves.values():
        value[rows] = -bo.LEARNING_RATE * g[rows].sum() / h[rows].sum()
    return splits, value


def paths(tree):
    out, todo = {}, [(0, "")]
    while todo:
        i, path = todo.pop()
        if tree.left[i] != i:
            out[path] = (int(tree.feature[i]), int(tree.cut[i]))
            todo += [(int(tree.left[i]), path + "L"), (int(tree.right[i]), path + "R")]
    return out


@pytest.mark.parametrize("small", [1 << 13, 150, 0])
def test_trees_equal_a_plain_learner(spark, monkeypatch, small):
    """The same splits whether one task finishes a tree, or passes count its upper or all nodes; several blocks, folds and feature sets."""
    monkeypatch.setattr(bo, "SMALL", small)
    monkeypatch.setattr(bo, "ROWS", 200)
    monkeypatch.setattr(bo, "KEEP", 2)
    x, y, folds = data(900)
    rows = frame(spark, x, y, folds, parts=3)
    edges = bo.bin_edges(rows, 4, bins=40)
    assert len(edges[1]) == 8 and len(edges[3]) == 2 and len(edges[0]) <= 39
    fits = [bo.Fit((0, 1, 2, 3), 0, 1, 3), bo.Fit((1, 2), 1, 2, 3), bo.Fit((0, 3), iterations=2)]
    run = bo.Boosting(bo.packed(rows, edges, 4, 2), edges, fits, 2)
    got = run.run()
    for fit, ensemble in zip(fits, got):
        use = fit.rows(folds)
        share = y[use].mean()
        raw = np.full(use.sum(), math.log(share / (1 - share)))
        assert len(ensemble.trees) == fit.iterations
        for tree in ensemble.trees:
            splits, value = plain_tree(x[use], y[use], raw, fit.features, edges)
            assert paths(tree) == splits and len(splits) > 3
            raw = raw + value
        assert np.allclose(ensemble.raw(x[use]), raw, atol=1e-12)
    out = run.out_of_fold().collect()
    assert {(r["fit"], r["key"]) for r in out} == {(k, i) for k, f in enumerate(fits) for i in np.flatnonzero(~f.rows(folds))}
    for r in out[::37]:
        assert abs(r["score"] - 1 / (1 + math.exp(-got[r["fit"]].raw(x[r["key"]][None])[0]))) < 1e-12 and r["label"] == y[r["key"]]
    run.release()


def test_early_stop_on_a_held_out_tenth(spark, monkeypatch):
    monkeypatch.setattr(bo, "EARLY_ROWS", 500)
    x, y, folds = data(800, seed=3)
    rows = frame(spark, x, y, folds, parts=2)
    edges = bo.bin_edges(rows, 4)
    run = bo.Boosting(bo.packed(rows, edges, 4, 2), edges, [bo.Fit((0, 1, 2, 3))], 2)
    trees = run.run()[0].trees
    losses = run.fits[0].losses
    aside = bo.held_out(np.arange(800), 0)
    assert 0.05 < aside.mean() < 0.15 and bo.EARLY_PATIENCE <= len(trees) < bo.ITERATIONS
    reference = losses[-bo.EARLY_PATIENCE - 1] - bo.EARLY_TOLERANCE
    assert all(v > reference for v in losses[-bo.EARLY_PATIENCE:])
    assert trees[0].cover[0] == 800 - aside.sum()


def test_constant_and_empty_inputs(spark):
    for x, y in ((np.zeros((60, 2)), np.arange(60) % 2), (np.random.default_rng(1).random((60, 2)), np.ones(60, dtype=int)), (np.random.default_rng(1).random((10, 2)), np.arange(10) % 2)):
        rows = frame(spark, x, y, np.zeros((len(x), 1), dtype=int))
        edges = bo.bin_edges(rows, 2)
        run = bo.Boosting(bo.packed(rows, edges, 2, 1), edges, [bo.Fit((0, 1), iterations=2), bo.Fit((0, 1), 0, 0, 2)], 1)
        whole, none = run.run()
        assert all(len(t.left) == 1 for t in whole.trees) or y.mean() not in (0, 1)
        assert np.isfinite(whole.raw(x)).all() and none.trees == []  # the second fit has no rows


def test_logistic_fits_equal_single_ones(spark, sf):
    train = features_of(spark, sf).where(F.col("split") == "train").withColumn("k", F.col("name").cast("bigint"))
    train = train.withColumn("founded_year", F.when(F.col("k") % 7 == 0, None).otherwise(F.col("founded_year")))
    specs = [mo.spec_by_name("logistic_regression_full"), mo.spec_by_name("logistic_regression_clean")]
    scores = mo.cross_validated(specs, train, "k", n_splits=3, repeats=2)
    assert scores.count() == 4 * train.count()
    rows = mo.folded(specs[0].columns, train, "k", 3, 2, 42)
    for spec, r, f in ((specs[0], 0, 1), (specs[1], 1, 2)):
        exact = mo.ModelSpec(spec.name, "lr", spec.numeric, spec.categorical, "onehot", spec.feature_set, True, {"maxIter": 2000, "tol": 1e-13})
        fold = F.get("folds", F.lit(r))
        single = mo.fit(exact, rows.where(fold != f)).transform(rows.where(fold == f)).select("k", F.col("score").alias("one"))
        both = scores.where((F.col("model_name") == spec.name) & (F.col("repeat") == r) & (F.col("fold") == f)).join(single, "k")
        n, gap = both.agg(F.count("*"), F.max(F.abs(F.col("score") - F.col("one")))).first()
        assert n == rows.where(fold == f).count() and gap < 1e-6


def test_many_fits_of_the_catalogue(spark, sf):
    train = features_of(spark, sf).where(F.col("split") == "train").withColumn("k", F.col("name").cast("bigint"))
    scores = mo.cross_validated(mo.build_specs(), train, "k", n_splits=2, repeats=2)
    n = train.count()
    assert {tuple(r) for r in scores.groupBy("model_name", "repeat").agg(F.countDistinct("k"), F.count("*")).collect()} == {(s.name, r, n, n) for s in mo.build_specs() for r in (0, 1)}
    assert scores.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_rows_that_share_a_key(spark):
    """Every row is held out once a repeat, with one fold a repeat, also where keys repeat with the same label or another."""
    rows = [(i // 2 if i < 60 else i, int(i % 5 < 2) if i < 90 else int(i % 20 // 2 % 5 < 2), float(i % 7), f"c{i % 3}") for i in range(200)]
    train = spark.createDataFrame(rows + rows[100:130] * 2, "k long, label int, a double, c string")
    folds = mo.folded(["a", "c"], train, "k", 3, 4, 42)
    assert folds.count() == 260 and folds.where("size(folds) <> 4 OR exists(folds, f -> f IS NULL OR f < 0 OR f > 2)").count() == 0
    assert folds.groupBy("k", "label").agg(F.countDistinct("folds").alias("n")).where("n > 1").count() == 0
    specs = [mo.ModelSpec("d", "dummy", ["a"], ["c"], "onehot", "full", False), mo.ModelSpec("l", "lr", ["a"], ["c"], "onehot", "full", True),
             mo.ModelSpec("b", "gbt", ["a"], ["c"], "ordinal", "full", False, {"maxIter": 2})]
    scores = mo.cross_validated(specs, train, "k", n_splits=3, repeats=2)
    assert {tuple(r) for r in scores.groupBy("model_name", "repeat").count().collect()} == {(s.name, r, 260) for s in specs for r in (0, 1)}
