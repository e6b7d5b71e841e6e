"""Models: calibration split/method, cohort back-off, contributions additivity, bootstrap PAV, stream = batch."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import calibration as ca
from cohortlab.operators import explain as ex
from cohortlab.operators import grouping as gr
from cohortlab.operators import modeling as mo
from cohortlab.operators import serving as sv


@pytest.fixture(scope="module")
def features(spark, sf):
    from cohortlab.plans.q_etl import features_of
    return features_of(spark, sf).checkpoint(eager=True)


def test_calibration_method_boundary():
    assert mo.calibration_method(1000) == "isotonic"
    assert mo.calibration_method(999) == "sigmoid"


def test_stratified_holdout_exact_and_disjoint(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1000)], "k long, label int")
    parts = mo.stratified_holdout(df, "k").collect()
    cal = [r for r in parts if r.part == "calibration"]
    pos = sum(1 for r in df.collect() if r.label == 1)
    assert sum(r.label for r in cal) == round(0.2 * pos)
    assert len(cal) == round(0.2 * pos) + round(0.2 * (1000 - pos))
    assert len({r.k for r in parts}) == 1000


def test_folds_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "k long, label int")
    f = mo.assign_folds(df, "k", 5, repeats=2).toPandas()
    counts = f.groupby(["repeat", "fold", "label"]).size().unstack()
    assert (counts.max() - counts.min()).max() <= 1


def test_cohort_backoff(spark):
    rows = ([("US", "Apps", 5e5, i % 2) for i in range(50)]          # exact level, n = 50
            + [("US", "Web", 5e6, 1) for _ in range(20)] + [("US", "Web", 5e4, 0) for _ in range(20)]
            + [("DE", "Bio", 5e5, i % 5 == 0) for i in range(10)] + [("DE", "Ag", 5e5, 1) for _ in range(25)])
    train = spark.createDataFrame([(c, k, u, int(l)) for c, k, u, l in rows],
                                  "country_code string, primary_category string, funding_total_usd double, label int")
    req = spark.createDataFrame([(1, "US", "Apps", 5e5), (2, "US", "Web", 5e5), (3, "DE", "Bio", 5e5), (4, "FR", "Apps", 5e5)],
                                "request_id int, country_code string, primary_category string, funding_total_usd double")
    got = {r.request_id: r for r in gr.cohort_lookup(req, train).collect()}
    assert got[1].level == "country+category+funding_band" and got[1].cohort_n == 50 and got[1].cohort_success_rate == 0.5
    assert got[2].level == "country+category" and got[2].cohort_n == 40
    assert got[3].level == "country" and got[3].cohort_n == 35 and got[3].cohort_category is None
    assert got[4].level is None and got[4].cohort_n is None


def test_pooling_is_monotone_and_associative():
    rng = np.random.default_rng(1)
    x = np.sort(rng.random(500))
    w = rng.integers(1, 5, 500).astype(float)
    wpos = np.minimum(w, rng.binomial(4, x).astype(float))
    lo, hi, pw, pp = ca.pool(x, x, w, wpos)
    assert (np.diff(pp / pw) > 0).all() and pw.sum() == w.sum() and pp.sum() == wpos.sum()
    first = [ca.pool(x[i:i + 50], x[i:i + 50], w[i:i + 50], wpos[i:i + 50]) for i in range(0, 500, 50)]
    again = ca.pool(*(np.concatenate(c) for c in zip(*first)))
    assert all(np.allclose(u, v) for u, v in zip(again, (lo, hi, pw, pp)))


def test_poisson_draws(spark):
    u = spark.range(3000).select(((F.col("id") + 0.5) / 3000).alias("u"))
    for n in (0, 1, 2, 40, 5000):
        x = np.array([r[0] for r in u.select(ca.poisson_draw(F.col("u"), F.lit(n))).collect()])
        assert abs(x.mean() - n) <= 0.02 * max(n, 1) ** 0.5 + 1e-9 and abs(x.var() - n) <= 0.03 * max(n, 1)


def test_multinomial_replicates_have_exactly_n_rows(spark):
    """Totals are conserved, means and variances of a cell are those of draws with replacement, trees of one to four levels agree on that."""
    cells = spark.createDataFrame([(i / 40, i % 5, (3 * i) % 7) for i in range(40)], "score double, n0 long, n1 long")
    n = cells.selectExpr("sum(n0 + n1)").first()[0]
    for fan in (1024, 9, 3):
        got = ca.multinomial_cells(cells, 400, 1, fan).cache()
        assert {r[1] for r in got.groupBy("replicate").sum("w").collect()} == {float(n)} and got.select("replicate").distinct().count() == 400
        assert got.where("wpos > w OR wpos < 0").count() == 0
        for r in cells.where("score IN (0.15, 0.6, 0.975)").collect():
            own = [x for x in got.where(F.col("score") == r.score).collect()]
            for have, share in (([x.wpos for x in own], r.n1 / n), ([x.w for x in own], (r.n0 + r.n1) / n)):
                have = np.array(have + [0.0] * (400 - len(have)))
                assert abs(have.mean() - n * share) < 5 * (n * share * (1 - share) / 400) ** 0.5 + 1e-9
                assert abs(have.var() / (n * share * (1 - share)) - 1) < 0.5 if share else have.var() == 0
        again = ca.multinomial_cells(cells.repartition(5), 400, 1, fan)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert ca.multinomial_cells(cells.limit(0), 3, 1).count() == 0
    cal = spark.createDataFrame([(i % 7 / 7, i % 2) for i in range(300)], "raw_score double, label int")
    for method in ("isotonic", "sigmoid"):
        assert ca.bootstrap_curves(ca.bootstrap_cells(cal, n_bootstrap=5), method).select("replicate").distinct().count() == 5
    assert ca.bootstrap_cells(cal, n_bootstrap=50, mode="poisson").groupBy("replicate").sum("w").select("sum(w)").distinct().count() > 1


def test_bootstrap_cells_and_bands_above_the_old_limit(spark):
    """12,000 distinct scores: no grid, one refit per replicate, bands around the isotonic fit."""
    cal = spark.range(12000).select(((F.col("id") + 0.25) / 12000).alias("raw_score"), (F.rand(3) < (F.col("id") + 0.25) / 12000).cast("int").alias("label")).cache()
    cells = ca.bootstrap_cells(cal, n_bootstrap=20)
    assert cells.select("score").distinct().count() == 12000
    curves = ca.bootstrap_curves(cells).cache()
    assert curves.select("replicate").distinct().count() == 20 and curves.count() < 20 * 2000
    req = spark.createDataFrame([(0.2,), (0.5,), (0.8,)], "raw_score double")
    for r in ca.bootstrap_band(req, curves).collect():
        assert r.band_lower - 0.05 <= r.raw_score <= r.band_upper + 0.05 and r.band_upper - r.band_lower < 0.3


def test_bootstrap_refits_the_sigmoid(spark):
    rng = np.random.default_rng(2)
    raw = rng.random(600)
    cal = spark.createDataFrame([(float(a), int(b)) for a, b in zip(raw, rng.random(600) < raw)], "raw_score double, label int")
    point = {round(r.raw_score, 9): r.probability for r in ca.fit_calibrator(cal, "sigmoid").transform(cal.limit(50)).collect()}
    curves = ca.bootstrap_curves(ca.bootstrap_cells(cal, n_bootstrap=100), "sigmoid")
    band = ca.bootstrap_band(cal.limit(50), curves, method="sigmoid").collect()
    inside = [r.band_lower <= point[round(r.raw_score, 9)] <= r.band_upper for r in band]
    assert np.mean(inside) >= 0.95


def test_leaf_shap_equals_subset_enumeration():
    """Against the definition, for a random tree over more features than the old limit of 12."""
    import itertools
    import math
    rng = np.random.default_rng(4)
    tree, todo = {}, [(0, 0, 1000.0)]
    while todo:
        nid, depth, cover = todo.pop()
        if depth == 4 or cover < 40:
            tree[nid] = {"prediction": float(rng.normal()), "cover": cover, "left": -1, "right": -1, "feature": -1, "threshold": None}
            continue
        share = 0.2 + 0.6 * rng.random()
        tree[nid] = {"prediction": 0.0, "cover": cover, "left": 2 * nid + 1, "right": 2 * nid + 2, "feature": int(rng.integers(0, 15)), "threshold": float(rng.random())}
        todo += [(2 * nid + 1, depth + 1, cover * share), (2 * nid + 2, depth + 1, cover * (1 - share))]
    x = rng.random((5, 15))
    phi, total, base = ex._leaf_values(x, ex._leaf_table(0.5, tree))

    def expect(row, nid, known):
        node = tree[nid]
        if node["left"] < 0:
            return 0.5 * node["prediction"]
        if node["feature"] in known:
            return expect(row, node["left"] if row[node["feature"]] <= node["threshold"] else node["right"], known)
        l, r = tree[node["left"]]["cover"], tree[node["right"]]["cover"]
        return (l * expect(row, node["left"], known) + r * expect(row, node["right"], known)) / (l + r)

    used = sorted({n["feature"] for n in tree.values() if n["left"] >= 0})
    for i in range(5):
        assert abs(total[i] - expect(x[i], 0, set(used))) < 1e-12 and abs(base - expect(x[i], 0, set())) < 1e-12
        for f in used:
            rest, want = [g for g in used if g != f], 0.0
            for n in range(len(rest) + 1):
                weight = math.factorial(n) * math.factorial(len(used) - n - 1) / math.factorial(len(used))
                want += weight * sum(expect(x[i], 0, {*s, f}) - expect(x[i], 0, set(s)) for s in itertools.combinations(rest, n))
            assert abs(phi[i, f] - want) < 1e-9


def test_tree_shap_additivity_and_linear(spark, features):
    train = features.where(F.col("split") == "train")
    test = features.where(F.col("split") == "test").limit(40)
    gbt = mo.fit(mo.ModelSpec("t", "gbt", ["founded_year", "time_to_first_funding_days"], ["country_code"],
                              "ordinal", "clean", False, {"maxIter": 10}), train)
    c = ex.tree_contributions(gbt, test, "permalink", top_n=3).collect()
    score = {r.permalink: r.score for r in gbt.transform(test).collect()}
    for r in c:
        assert abs(1 / (1 + np.exp(-r.margin)) - score[r.permalink]) < 1e-9
        assert len(r.contributions) == 3
        assert all(x.direction == ("increases" if x.shap_value > 0 else "decreases") for x in r.contributions)
    full = ex.tree_contributions(gbt, test, "permalink", top_n=3 + 0).collect()
    assert len(full) == len(c)
    lr = mo.fit(mo.spec_by_name("logistic_regression_clean"), train)
    lc = ex.linear_contributions(lr, test, train, "permalink").collect()
    assert all(len(r.contributions) == 5 for r in lc)


def test_validation_dead_letters(spark):
    req = spark.createDataFrame([
        ("a", "clean", 2000.0, 10.0, "USA", "SF", "Web", None, None, None),
        ("b", "full", 1800.0, 10.0, "TOOLONGCODE", "SF", "Web", None, None, None),
    ], "request_id string, feature_set string, founded_year double, time_to_first_funding_days double, "
       "country_code string, region string, primary_category string, funding_total_usd double, "
       "funding_rounds double, funding_span_days double")
    got = {r.request_id: r.errors for r in sv.validation_errors(req).collect()}
    assert got["a"] == []
    assert len(got["b"]) == 3
    default = req.withColumns({"feature_set": F.lit(None).cast("string"), "funding_rounds": F.lit(1.5)}).where("request_id = 'a'")
    assert sv.validation_errors(default).first().errors == ["funding_rounds must be an integer"]


def test_stream_equals_batch(spark, tmp_path):
    from cohortlab.streaming.scoring import REQUEST_SCHEMA, process_batch, run_stream
    rows = [(f"r{i}", i % 3, "clean" if i % 2 else "full", 1990.0 + i % 30, float(i), "NATION_1" if i % 4 else "NATION_12",
             "ASIA", "Web", 1e5 * i, 1.0 + i % 3, 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, REQUEST_SCHEMA)
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    _, dead_stream = run_stream(spark, src, str(tmp_path / "s"))
    process_batch(df, None, str(tmp_path / "b" / "scored"), str(tmp_path / "b" / "dead"))
    a = sorted(r.request_id for r in spark.read.parquet(dead_stream).collect())
    b = sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "b" / "dead")).collect())
    assert a == b and len(a) == 15
    process_batch(df, None, str(tmp_path / "b" / "scored"), str(tmp_path / "b" / "dead"))  # a replayed epoch
    assert spark.read.parquet(str(tmp_path / "b" / "dead")).count() == 15
    assert spark.read.parquet(str(tmp_path / "b" / "scored")).count() == 45


def test_facts_text(spark):
    contributions = "array<struct<feature:string,value:string,shap_value:double,direction:string>>"
    row = ("q", (0.5, 0.4, 0.45, 0.61, 70.04, [("founded_year", "2000.0", -0.25, "decreases"), ("region", "ASIA", 0.1, "increases")], "country+category", "US", "Web", 40, 0.125))
    schema = ("request_id string, facts struct<probability:double,raw_probability:double,band_lower:double,band_upper:double,percentile:double,"
              f"top_contributions:{contributions},cohort_level:string,cohort_country:string,cohort_category:string,cohort_n:long,cohort_success_rate:double>")
    text = sv.render_facts(spark.createDataFrame([row], schema), foreground=F.lit("founded_year")).first().answer
    assert "- You asked about `founded_year`: it decreases the score (SHAP -0.250, value = 2000.00)." in text
    assert "| `founded_year` | 2000.00 | -0.250 | decreases |\n| `region` | ASIA | +0.100 | increases |" in text
    assert text.endswith("- Matching cohort (country + category = US, Web, n=40): observed success rate **12.5%** in the training data.")
    assert "You asked" not in sv.render_facts(spark.createDataFrame([row], schema), foreground=F.lit("other")).first().answer


def test_requests_are_scored_by_their_feature_set(spark, features):
    train = features.where(F.col("split") == "train")
    models = {}
    for name, column in (("clean", "founded_year"), ("full", "funding_rounds")):
        spec = mo.ModelSpec(name, "gbt", [column], ["country_code"], "ordinal", name, False, {"maxIter": 3})
        base = mo.fit(spec, train)
        raw = base.transform(train).withColumnRenamed("score", "raw_score")
        calibrator = ca.fit_calibrator(raw, "sigmoid")
        reference = calibrator.transform(raw).select(F.col("probability").alias("score")).cache()
        curves = ca.bootstrap_curves(ca.bootstrap_cells(raw, n_bootstrap=5), "sigmoid").cache()
        models[name] = sv.ServingModel(name, name, base, calibrator, "sigmoid", reference, reference, curves, train)
    req = features.where(F.col("split") == "test").limit(30).withColumn("request_id", F.col("permalink")).withColumn(
        "feature_set", F.when(F.col("name").cast("long") % 3 == 0, "full").when(F.col("name").cast("long") % 3 == 1, "clean")).cache()
    got = {r.request_id: r for r in sv.score_requests(models, req).collect()}
    assert len(got) == req.count()
    for r in req.collect():
        want = r.feature_set or "clean"
        assert got[r.request_id].feature_set == want
        assert {c.feature for c in got[r.request_id].contributions} == set(models[want].base.spec.columns)


def test_sigmoid_calibrator(spark):
    rng = np.random.default_rng(5)
    raw = rng.random(400)
    y = (rng.random(400) < raw).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(raw, y)], "raw_score double, label int")
    cal = ca.fit_calibrator(df, "sigmoid")
    out = sorted((r.raw_score, r.probability) for r in cal.transform(df).collect())
    probs = [p for _, p in out]
    assert probs == sorted(probs) and 0 < probs[0] < probs[-1] < 1
    iso = ca.fit_calibrator(df, "isotonic")
    ip = [r.probability for r in sorted(iso.transform(df).collect(), key=lambda r: r.raw_score)]
    assert ip == sorted(ip)


def test_cross_validation_any_spec(spark, features):
    """The CV driver runs any spec: a small boosted model, 2 folds x 2 repeats, every row held out once per repeat."""
    from cohortlab.operators import metrics as me
    train = features.where(F.col("split") == "train").withColumn("k", F.col("name").cast("bigint"))
    spec = mo.ModelSpec("gbt_small", "gbt", ["founded_year"], ["country_code"], "ordinal", "clean", False,
                        {"maxIter": 5})
    scores = mo.cross_validated_scores(spec, train, "k", n_splits=2, repeats=2)
    n = train.count()
    per_repeat = {r.repeat: r["count"] for r in scores.groupBy("repeat").count().collect()}
    assert per_repeat == {0: n, 1: n}
    auc = me.roc_auc(scores, ["repeat", "fold"]).collect()
    assert len(auc) == 4 and all(0.0 <= r.roc_auc <= 1.0 for r in auc)
