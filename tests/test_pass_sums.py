"""Passes of large boosted fits: one gathering of rows a tree, the smaller sibling counted, features counted together."""
import numpy as np
import pytest

from cohortlab.operators import boosting as bo
from tests.test_whole_fits import FITS, table, trained  # noqa: F401


def test_rows_are_gathered_once_a_tree(table, monkeypatch):  # noqa: F811
    """Small nodes wait until nothing is left to count, so a tree's rows move once, and count passes have a stage without a shuffle."""
    seen, gathered = bo.Boosting._splits, []

    def splits(self, orders):
        for k, order in orders.items():
            assert not (order.count and order.room)
            counted = [self.fits[k].rows(node) for node in order.count]
            assert all(2 * n <= self.fits[k].rows(self.fits[k].parent[node]) for n, node in zip(counted, order.count) if node)
            gathered.extend([(k, len(self.fits[k].trees))] * bool(order.room))
        return seen(self, orders)

    monkeypatch.setattr(bo.Boosting, "_splits", splits)
    monkeypatch.setattr(bo, "WHOLE", 0)
    monkeypatch.setattr(bo, "SMALL", 150)
    trees, _, _ = trained(*table)
    assert sorted(gathered) == [(k, t) for k, fit in enumerate(trees) for t in range(len(fit))]


@pytest.mark.parametrize("small", [0, 150])
def test_many_fits_are_added_up_by_tasks(table, monkeypatch, small):  # noqa: F811
    whole = trained(*table)
    monkeypatch.setattr(bo, "WHOLE", 0)
    monkeypatch.setattr(bo, "SMALL", small)
    monkeypatch.setattr(bo, "FEW", 0)
    assert trained(*table) == whole


@pytest.mark.parametrize("cells", [1, 40, 1 << 14])
def test_features_counted_together(monkeypatch, cells):
    monkeypatch.setattr(bo, "BUNDLE", cells)
    rng = np.random.default_rng(3)
    sizes = [7, 1, 30, 255, 4]
    layout = bo.Layout((0, 2, 3, 4, 6), sizes)
    assert sorted(j for b in layout.bundles for j in b) == list(range(5))
    x = np.zeros((900, 7), dtype=np.uint8)
    for f, s in zip(layout.features, sizes):
        x[:, f] = rng.integers(0, s, 900)
    rows = np.flatnonzero(rng.random(900) < 0.6)
    g, h = rng.integers(-9, 9, len(rows)).astype(float), rng.integers(0, 9, len(rows)).astype(float)
    want = layout.histograms(x[rows], None, 1, g, h)[0]
    assert (layout.counted(layout.codes(x, rows), g, h) == want).all()
    assert (layout.counted(layout.codes(x[rows]), g, h) == want).all()
    assert (layout.of_rows(x, rows, g, h) == want).all()


def test_gathered_rows_are_dealt_evenly():
    sizes = {("rows", 0, node): n for node, n in enumerate([9, 1, 8, 3, 7, 5, 2, 6, 4, 0])}
    place = bo.dealt_evenly(sizes, 3)
    held = [sum(n for key, n in sizes.items() if place[key] == i) for i in range(3)]
    assert set(place) == set(sizes) and max(held) - min(held) <= 2
