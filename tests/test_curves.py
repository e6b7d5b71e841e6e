"""Curves of bounded size: number of points, area bound, hull, small and degenerate curves."""
import numpy as np
import pytest

from cohortlab.operators import metrics as me


def _scored(spark, y, p):
    return spark.createDataFrame(list(zip(map(int, y), map(float, p))), "label int, score double")


def _area(points):
    pts = sorted((r["fpr"], r["tpr"]) for r in points)
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))


@pytest.mark.parametrize("max_points", [4, 20, 100])
def test_roc_area_and_size(spark, max_points):
    rng = np.random.default_rng(max_points)
    y = rng.random(4000) < 0.2
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 4)
    s = _scored(spark, y, p)
    full, thin = me.roc_points(s).collect(), me.roc_points(s, max_points).collect()
    assert len(thin) <= max_points < len(full) and set(thin) <= set(full)
    auc = me.roc_auc(s).first()[0]
    assert abs(_area(full) - auc) < 1e-9
    assert abs(_area(thin) - auc) <= 1 / (2 * ((max_points - 1) // 3))
    assert {(0.0, 0.0), (1.0, 1.0)} <= {(r["fpr"], r["tpr"]) for r in thin}


def test_roc_corner_is_kept(spark):
    """A sharp corner inside a slot is the point farthest above the slot's chord."""
    y = [1] * 50 + [0] * 50
    p = [0.9 + i / 1000 for i in range(50)] + [0.1 + i / 1000 for i in range(50)]
    thin = {(r["fpr"], r["tpr"]) for r in me.roc_points(_scored(spark, y, p), 4).collect()}
    assert (0.0, 1.0) in thin


def test_pr_brackets_average_precision(spark):
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.3
    s = _scored(spark, y, np.round(np.clip(rng.normal(0.4 + 0.15 * y, 0.2), 0, 1), 4))
    full = sorted(me.pr_points(s).collect(), key=lambda r: -r["threshold"])
    thin = me.pr_points(s, 101).collect()
    assert len(thin) <= 101 < len(full) and set(thin) <= set(full)
    ap = me.average_precision(s).first()[0]
    low = high = 0.0
    slot = lambda r: min(int(r["recall"] * 25), 24)
    kept = {}
    for r in thin:
        if r["threshold"] != float("inf"):
            kept.setdefault(slot(r), []).append(r["precision"])
    for a, b in zip(full, full[1:]):
        low += (b["recall"] - a["recall"]) * min(kept[slot(b)])
        high += (b["recall"] - a["recall"]) * max(kept[slot(b)])
    assert low - 1e-9 <= ap <= high + 1e-9


def test_few_points_are_all_kept(spark):
    s = _scored(spark, [0, 1, 1], [.2, .2, .7])
    assert sorted(me.roc_points(s, 4).collect()) == sorted(me.roc_points(s).collect())
    assert sorted(me.pr_points(s, 5).collect()) == sorted(me.pr_points(s).collect())
    with pytest.raises(ValueError):
        me.roc_points(s, 3)
