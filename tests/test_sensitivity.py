"""Sensitivity curves of boosted trees: rows are prepared and walk the trees once, with the scores of the expanded rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import boosting as bo
from cohortlab.operators import calibration as ca
from cohortlab.operators import explain as ex
from cohortlab.operators import modeling as mo
from tests.test_many_fits import data, frame


@pytest.fixture(scope="module")
def fitted(spark):
    """A boosted model of two numbers, one with gaps, and a category; rows to explain, some with a null or unseen value."""
    rng = np.random.default_rng(4)
    rows = [(str(i), int(rng.random() < 0.3 + 0.4 * (i % 7 > 3)), None if i % 11 == 0 else float(i % 7), float(rng.random()), None if i % 13 == 0 else f"c{i % 5}") for i in range(700)]
    df = spark.createDataFrame(rows, "name string, label int, a double, b double, c string")
    return mo.fit(mo.ModelSpec("m", "gbt", ["a", "b"], ["c"], "ordinal", "full", False, {"maxIter": 12}), df), df.where("name < 4").withColumn("c", F.when(F.col("name") == "1", "new").otherwise(F.col("c")))


@pytest.mark.parametrize("feature, grid", [("a", [0.0, 1.5, 1.6, 6.0, 6.0]), ("b", [0.9, 0.2, 0.5]), ("a", [None, 3.0]), ("b", [])])
def test_rows_are_not_expanded_before_scoring(spark, fitted, monkeypatch, feature, grid):
    model, rows = fitted
    points = spark.createDataFrame([(v,) for v in grid], "grid_value double")
    method = ca.fit_calibrator(rows.select(F.col("b").alias("raw_score"), "label"), "isotonic")
    want = {}
    for calibrator in (None, method):
        long = model.transform(rows.crossJoin(points).withColumn(feature, F.col("grid_value")))
        if calibrator is not None:
            long = calibrator.transform(long.withColumnRenamed("score", "raw_score"), "raw_score", "score")
        want[calibrator] = sorted(map(repr, map(tuple, long.select("name", "grid_value", "score").collect())))
    monkeypatch.setattr(mo.FittedModel, "transform", lambda *_: pytest.fail("scores rows times grid points"))
    for calibrator in (None, method):
        got = ex.sensitivity(model, rows, "name", feature, points, calibrator)
        assert got.columns == ["name", "grid_value", "predicted_probability"]
        assert sorted(map(repr, map(tuple, got.collect()))) == want[calibrator]


def test_curves_equal_replaced_bins(spark):
    x, y, folds = data(700)
    rows = frame(spark, x, y, folds)
    edges = bo.bin_edges(rows, 4, bins=40)
    run = bo.Boosting(bo.packed(rows, edges, 4, 2), edges, [bo.Fit((0, 1, 2, 3), iterations=6)], 2)
    model = run.run()[0]
    run.release()
    for f in range(4):
        bins = np.arange(0, len(edges[f]) + 1, 1 + f % 2)
        got = model.curves(x, f, bins)
        for i, b in enumerate(bins):
            other = x.copy()
            other[:, f] = edges[f][b] if b < len(edges[f]) else edges[f][-1] + 1
            assert (got[i] == model.raw(other)).all()
