"""Learned operators: held-out accuracy, fixed cases, and the mix against its targets."""
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlab.llm import language, mixing, quality_model, queries

import brute

MID = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_held_out_accuracy(spark):
    rows = queries.QUERIES["op1_language_id"](spark, MID).collect()
    truth = dict(brute.rows_of(spark.read.parquet(f"{MID}/documents.parquet"), "doc_id", "lang"))
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_language_odd_rows(docs_of, odd):
    rows = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4 and rows[0]["score"] == 0 and len(rows) == 13
    assert {r["lang_pred"] for r in language.identify(docs_of([("some words", None, "a")] * 5)).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_predictions_ignore_everything_but_the_text(docs_of, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.select("doc_id", "lang", "text"))
    mixed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6})
    one = {r["doc_id"] + 10**6: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert one == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(mixed, model).collect()}


def test_codewords_are_apart_and_correct_errors():
    for n in (2, 3, 4, 5, 12, 40):
        code = language.codewords(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= (1 if n < 3 else 2)
    model = language.Model(["a", "b", "c", "d"], np.ones((4, language.BUCKETS * 3)))
    margins = 4.0 * model.code[[2]]
    margins[0, 0] *= -1  # one bit errs
    assert model.losses(margins).argmin() == 2


def test_gram_counts_do_not_cross_texts():
    texts = pa.array(["abc def", "", None, "é"])
    whole = np.concatenate([c for _, c in language.gram_counts(texts)])
    alone = np.concatenate([c for t in texts.to_pylist() for _, c in language.gram_counts(pa.array([t or ""]))])
    assert (whole == alone).all() and whole[1].sum() == 0


def test_quality_held_out_accuracy(spark):
    rows = queries.QUERIES["op6_quality_model"](spark, MID).collect()
    truth = dict(brute.rows_of(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id", "quality"))
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1000 and all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, "x"), (4, 1, "x"), (5, 0, "x"), (6, 0, "x"), (10, 0, "x"), (99, 1, "x"), (7, None, "x"), (6, 0, "x")], "doc_id long, quality int, text string")
    rows = quality_model.quality_scores(odd, labels).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality_model.quality_scores(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_model.quality_scores(odd.limit(0), labels).count() == 0


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    width = len(quality_model.NAMES)
    x = {0: rng.normal(0, 1, (500, width)), 1: rng.normal(1, 2, (700, width))}
    model = quality_model.Discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    z, odds = rng.normal(0.5, 1, width), math.log(701 / 501)
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in x.values()) / 1200
    for c, sign in ((1, 1), (0, -1)):
        cov = (1 - quality_model.POOL) * np.cov(x[c].T, bias=True) + quality_model.POOL * pooled
        cov = (1 - quality_model.DIAGONAL) * cov + (quality_model.DIAGONAL + 1e-9) * np.diag(np.diag(cov)) + quality_model.FLOOR * np.eye(width)
        d = z - x[c].mean(0)
        odds += sign * (-0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert math.isclose(model.score(z[None])[0], 1 / (1 + math.exp(-odds)), rel_tol=1e-6)


def check_mix(docs, **knobs):
    rows = mixing.mixed_sizes(docs, **knobs).collect()
    told = {d: (s, brute.measures(t)[0]) for d, s, t in brute.rows_of(docs, "doc_id", "source", "text")}
    sizes, taken = {}, {}
    for r in rows:
        s, n = told[r["doc_id"]]
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n and (r["taken"] == 0) == (len(r["shards"]) == 0)
        sizes[s], taken[s] = sizes.get(s, 0) + n, taken.get(s, 0) + r["taken"]
    want = brute.targets(sizes)
    for r in rows:
        s = told[r["doc_id"]][0]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(taken[s] - want[s]) <= 1
    return rows


def test_mix_meets_its_targets(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = check_mix(docs, block=64, shard=1024)
    assert len(check_mix(docs)) == 200
    again = mixing.mixed_sizes(docs.repartition(7), block=64, shard=1024).collect()
    assert sorted(small) == sorted(again)
    check_mix(odd, block=16, shard=64)
    check_mix(odd.limit(0))
    check_mix(odd.where("doc_id < 3"))


def test_mix_caps_and_reshares(docs_of):
    rows = [("a " * 10, "en", "s0")] + [("b " * 500, "en", "s1")] + [("c " * 100, "en", "s2")] + [("d " * 2000, "en", None)]
    out = {r["doc_id"]: r for r in check_mix(docs_of(rows), block=8, shard=64)}
    assert out[0]["target"] == 30 and out[0]["taken"] == 30


def test_shards_get_conserved_disjoint_blocks(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 55), (2, 1), (5, 244)], "place int, quota long")
    rows = mixing.shard_quotas(quotas, 16, 3).collect()
    seats = {}
    for r in rows:
        seats.setdefault(r["place"], []).extend(range(r["begin"], r["begin"] + r["quota"]))
    assert {p: sorted(s) for p, s in seats.items()} == {p: list(range(q)) for p, q in ((0, 700), (1, 55), (2, 1), (5, 244))}
    per = {}
    for r in rows:
        per[r["shard"]] = per.get(r["shard"], 0) + r["quota"]
    assert len(per) == 63 and set(per.values()) <= {15, 16}


def test_hypergeometric_draws(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    for total, good, drawn in ((10, 4, 5), (1000, 300, 500), (7, 7, 3), (5, 0, 2), (100000, 30000, 50000)):
        x = [r[0] for r in u.select(mixing.hypergeometric(F.col("u"), F.lit(total), F.lit(good), F.lit(drawn)).alias("x")).collect()]
        mean, var = drawn * good / total, drawn * good / total * (1 - good / total) * (total - drawn) / (total - 1)
        assert min(x) >= max(0, drawn + good - total) and max(x) <= min(good, drawn)
        assert abs(np.mean(x) - mean) < 0.01 * max(1, var**0.5) and abs(np.var(x) - var) <= 0.02 * var + 1e-9


def test_mixed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mixing.mixed_documents(docs.withColumn("copy", F.lit("x")), block=64, shard=1024)
    words = {r["doc_id"]: r["w"] for r in mix.groupBy("doc_id").agg(F.sum("words").alias("w")).collect()}
    assert words == {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(docs, block=64, shard=1024).collect() if r["taken"]}
    slots = mix.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 for r in slots)


def test_blocks_are_permuted(spark):
    """Every quota, also the divisors of 2**31 - 2: each seat once, and few blocks stay beside their neighbours."""
    quotas = [1, 2, 3, 6, 7, 9, 11, 14, 18, 21, 22, 31, 42, 62, 66, 93, 154, 302, 1000, 20000]
    table = spark.createDataFrame(list(enumerate(quotas)), "place long, quota long")
    ranges = mixing.shard_quotas(table, 32, 1)
    share = {(r["shard"], r["place"]): r["quota"] for r in ranges.collect()}
    got = mixing.seats(ranges, 1).collect()
    assert Counter((r["shard"], r["place"]) for r in got) == share
    assert {(r["place"], r["block"]) for r in got} == {(p, b) for p, q in enumerate(quotas) for b in range(q)} and len(got) == sum(quotas)
    shards = {(r["place"], r["block"]): r["shard"] for r in got}
    big = [shards[(19, b)] for b in range(20000)]
    assert sum(a == b for a, b in zip(big, big[1:])) < 200  # neighbouring blocks seldom share a shard
