"""Ordered dictionaries: distributed ranks against a sort, codes of unseen and null values, many categories."""
import re

from pyspark.sql import functions as F

from cohortlab.operators.dictionaries import Dictionary, long_values, ordered_values


def test_ranks_equal_a_sort(spark):
    rows = [(a, b) for a, b in zip(["b", "a", None, "é", "Z", "a", ""] * 3, ["x", None, "y", "x", "w", "", "w"] * 3)]
    df = spark.createDataFrame(rows, "first string, second string")
    got = {(r["feature"], r["value"]): r["ord"] for r in ordered_values(long_values(df, ["first", "second"]), n_blocks=3).collect()}
    want = {}
    for i, c in enumerate(["first", "second"]):
        for k, v in enumerate(sorted({r[i] for r in rows if r[i] is not None}, key=lambda s: s.encode()), 1):
            want[c, v] = k
    assert got == want


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "c string")
    assert ordered_values(long_values(df, ["c"])).count() == 0
    assert Dictionary.fit(df, ["c"]).transform(spark.createDataFrame([("x",), (None,)], "c string")).select("c__o").distinct().collect()[0][0] == -1.0
    nulls = Dictionary.fit(spark.createDataFrame([(None,)], "c string"), ["c"])
    got = {r["c"]: r["c__o"] for r in nulls.transform(spark.createDataFrame([("x",), (None,)], "c string")).collect()}
    assert got == {"x": -1.0, None: 0.0}


def test_unseen_null_and_kept_columns(spark):
    train = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("zz", 4)], "c string, d int")
    test = spark.createDataFrame([("b", "k"), ("nope", "l"), (None, "m"), ("b", "n")], "c string, code string")
    d = Dictionary.fit(train, ["c"])
    got = {r["code"]: r["c__o"] for r in d.transform(test).collect()}
    assert got == {"k": 1.0, "l": -1.0, "m": 2.0, "n": 1.0}
    assert d.sizes() == [4] and d.transform(test).columns == ["c", "code", "c__o"]


def test_a_million_categories(spark):
    """The order of a million values of one feature comes from several ranges, and no window has one task."""
    df = spark.range(1_000_000).select(F.sha1(F.col("id").cast("string")).alias("c"))
    out = ordered_values(long_values(df, ["c"]), n_blocks=16)
    plan = out._jdf.queryExecution().toString()
    assert not re.search(r"Window .*partitionBy=\[\]", plan) and "SinglePartition" not in plan
    tail = out.agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.countDistinct("ord").alias("d")).first()
    assert tuple(tail) == (1_000_000, 1, 1_000_000, 1_000_000)
    values = sorted(r["c"] for r in df.collect())
    some = {r["ord"]: r["value"] for r in out.where(F.col("ord") % 99_991 == 0).collect()}
    assert some == {i: values[i - 1] for i in some} and len(some) == 10
    assert out.select("ord", F.floor((F.col("ord") - 1) / 250_000).alias("q")).groupBy("q").count().count() == 4
