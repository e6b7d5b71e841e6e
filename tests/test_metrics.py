"""Metric, threshold, band, ECDF and prefix-scan checks (fixtures of the reference's unit tests)."""
import numpy as np
from pyspark.sql import functions as F

from cohortlab.operators import metrics as me
from cohortlab.operators import prefix as px
from cohortlab.operators import uncertainty as un


def _scored(spark, y, p):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                 "key long, label int, score double")


def test_perfect_separation(spark):
    s = _scored(spark, [0, 0, 1, 1], [.1, .2, .8, .9])
    m = me.compute_metrics(s, 0.5).first()
    assert m.roc_auc == 1.0 and m.average_precision == 1.0
    assert (m.tn, m.fp, m.fn, m.tp) == (2, 0, 0, 2)


def test_threshold_effects(spark):
    s = _scored(spark, [0, 0, 1, 1], [.3, .6, .4, .9])
    assert me.confusion_at(s, 0.1).first().fp == 2
    assert me.confusion_at(s, 0.95).first().tp == 0


def test_f_half_prefers_precise_threshold(spark):
    s = _scored(spark, [0, 0, 0, 1, 1], [.2, .3, .55, .6, .9])
    assert me.choose_threshold(s).first().threshold >= 0.55


def test_auc_reversal_and_ties(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 2)
    s = _scored(spark, y, p)
    auc = me.roc_auc(s).first()[0]
    rev = me.roc_auc(s.withColumn("score", -F.col("score"))).first()[0]
    assert abs(auc + rev - 1.0) < 1e-12
    # brute force with half-counted ties
    pos, neg = p[y == 1], p[y == 0]
    bf = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(auc - bf) < 1e-12


def test_running_sums_match_single_window(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 50, 500)
    df = spark.createDataFrame([(int(v), i % 3) for i, v in enumerate(vals)], "v int, g int")
    cells = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.g, r.v): r.cum_n for r in px.running_sums(cells, "v", ["n"], ["g"], n_blocks=5).collect()}
    for (g, v), c in got.items():
        assert c == int(((vals <= v) & (np.arange(500) % 3 == g)).sum())


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    vals = rng.normal(size=257).round(3)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    qs = [0.01, 0.2, 0.5, 0.8, 0.99]
    got = sorted((r.q, r.value) for r in px.exact_quantiles(df, "x", qs).collect())
    for (q, v), e in zip(got, np.quantile(vals, qs)):
        assert abs(v - e) < 1e-9


def test_calibration_bins_have_all_rows(spark):
    rng = np.random.default_rng(3)
    p = rng.random(200)
    y = (rng.random(200) < p).astype(int)
    rc = me.reliability_curve(_scored(spark, y, p), n_bins=5).collect()
    assert sum(r.n for r in rc) == 200 and len(rc) == 5


def test_confidence_bands_sum_and_lookup(spark):
    rng = np.random.default_rng(4)
    p = rng.random(500)
    y = (rng.random(500) < p).astype(int)
    bands = un.confidence_bands(_scored(spark, y, p), n_bins=5)
    rows = sorted(bands.collect(), key=lambda r: r.bin)
    assert sum(r.n for r in rows) == 500
    assert rows[0].bin_lower == 0.0 and rows[-1].bin_upper == 1.0
    for r in rows:
        assert 0.0 <= r.ci_lower <= r.phat <= r.ci_upper <= 1.0
    # a shared edge belongs to the upper bin; 1.0 to the closed top bin
    edge = rows[1].bin_lower
    req = spark.createDataFrame([(1, edge), (2, 1.0), (3, -0.5)], "id int, probability double")
    got = {r.id: (r.band_lower, r.band_upper) for r in un.lookup_band(req, bands).collect()}
    assert got[1] == (rows[1].ci_lower, rows[1].ci_upper)
    assert got[2] == (rows[-1].ci_lower, rows[-1].ci_upper)
    assert got[3] == (rows[0].ci_lower, rows[0].ci_upper)


def test_wilson_empty_bin(spark):
    df = spark.createDataFrame([(0, 0), (5, 10)], "successes long, n long")
    r = sorted(un.wilson_table(df).collect(), key=lambda x: x.n)
    assert (r[0].ci_lower, r[0].ci_upper) == (0.0, 1.0)
    assert r[1].ci_lower < 0.5 < r[1].ci_upper


def test_percentile_extremes_and_monotone(spark):
    ref = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 101)], "score double")
    req = spark.createDataFrame([(1, -1.0), (2, 2.0), (3, 0.5), (4, 0.25)], "id int, probability double")
    got = {r.id: r.percentile for r in un.percentile_of(req, ref).collect()}
    assert got[1] == 0.0 and got[2] == 100.0 and 48 <= got[3] <= 52 and got[4] < got[3]


def test_bracket_summary_raises_on_a_miss(spark):
    import pytest
    from cohortlab.operators import uncertainty as un
    df = spark.createDataFrame([(0.5, 0.4, 0.6), (0.9, 0.1, 0.2)], "probability double, band_lower double, band_upper double")
    assert tuple(un.bracket_summary(df, strict=False).first()) == (2, 1)
    with pytest.raises(Exception, match="1 confidence bands do not bracket"):
        un.bracket_summary(df).collect()
    assert tuple(un.bracket_summary(df.limit(1)).first()) == (1, 1)
