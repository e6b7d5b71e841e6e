"""Boosted fits that one task grows: no passes, and the same trees, losses and scores as by passes."""
import numpy as np
import pytest

from cohortlab.operators import boosting as bo
from tests.test_many_fits import data, frame

FITS = [bo.Fit((0, 1, 2, 3), 0, 1, 4), bo.Fit((1, 2), 1, 2, 2), bo.Fit((0, 3), iterations=2)]


def trained(rows, edges):
    run = bo.Boosting(bo.packed(rows, edges, 4, 2), edges, FITS, 2)
    trees = [[np.stack([t.feature, t.cut, t.left, t.right, t.value, t.cover]).tolist() for t in e.trees] for e in run.run()]
    scores = sorted(map(tuple, run.out_of_fold().collect()))
    losses = [g.losses for g in run.fits]
    run.release()
    return trees, losses, scores


@pytest.fixture(scope="module")
def table(spark):
    rows = frame(spark, *data(900), parts=3).cache()
    return rows, bo.bin_edges(rows, 4, bins=40)


def test_small_fits_take_no_passes(table, monkeypatch):
    def refuse(*_):
        raise AssertionError("a pass for fits that a task holds")

    monkeypatch.setattr(bo.Boosting, "_splits", refuse)
    trees, _, scores = trained(*table)
    assert [len(t) for t in trees] == [4, 2, 2] and len(scores) > 500


def test_many_fits_of_more_rows_take_no_passes(table, monkeypatch):
    """More than FEW fits keep the tasks busy: each is grown whole up to SHARE times WHOLE rows, a few only up to WHOLE; beyond, passes grow the same."""
    rows, edges = table
    fits, passes, seen = [bo.Fit((0, 1, 2, 3), r, f, 2) for r in (0, 1) for f in (0, 1, 2)], [], bo.Boosting._splits

    def splits(self, orders):
        passes.append(len(orders))
        return seen(self, orders)

    def grown(fits):
        passes.clear()
        run = bo.Boosting(bo.packed(rows, edges, 4, 2), edges, fits, 2)
        trees = [[np.stack([t.feature, t.cut, t.left, t.right, t.value, t.cover]).tolist() for t in e.trees] for e in run.run()]
        run.release()
        return trees

    monkeypatch.setattr(bo.Boosting, "_splits", splits)
    monkeypatch.setattr(bo, "WHOLE", 200)  # a fit has about 600 rows
    many = grown(fits)
    assert not passes
    assert grown(fits[:3]) == many[:3] and passes
    monkeypatch.setattr(bo, "WHOLE", 100)
    assert grown(fits) == many and passes


@pytest.mark.parametrize("small, early", [(1 << 18, 500), (0, bo.EARLY_ROWS), (150, 500)])
def test_passes_give_the_same_fits(table, monkeypatch, small, early):
    """Beyond WHOLE rows passes grow the trees: bit by bit those of one task, with early stopping and without."""
    monkeypatch.setattr(bo, "EARLY_ROWS", early)
    whole = trained(*table)
    assert bool(whole[1][0]) == (early == 500)
    monkeypatch.setattr(bo, "WHOLE", 0)
    monkeypatch.setattr(bo, "SMALL", small)
    monkeypatch.setattr(bo, "KEEP", 3)
    assert trained(*table) == whole


def test_histograms_by_slot():
    rng = np.random.default_rng(5)
    sizes = [7, 1, 30]
    layout = bo.Layout((0, 2, 3), sizes)
    x = np.stack([rng.integers(0, s, 400) for s in (7, 9, 1, 30)], axis=1).astype(np.uint8)
    slot, g, h = rng.integers(0, 3, 400), rng.integers(-9, 9, 400).astype(float), rng.integers(0, 9, 400).astype(float)
    got = layout.histograms(x, slot, 3, g, h)
    for s in range(3):
        for f, size, first in zip(layout.features, sizes, layout.first):
            for b in range(size):
                own = (slot == s) & (x[:, f] == b)
                assert got[s, :, first + b].tolist() == [own.sum(), g[own].sum(), h[own].sum()]
    assert (layout.histograms(x, None, 1, g, h)[0] == got.sum(axis=0)).all()
