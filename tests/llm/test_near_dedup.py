import random

import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import near_dedup
from cohortlab.llm.components import components

import brute


def result(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}


def test_matches_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(docs) == brute.near_duplicates(brute.rows_of(docs, "doc_id", "text"))


def test_mutated_family_and_odd_rows(docs_of, odd):
    rng = random.Random(5)
    base = [f"word{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(60):  # from exact copies to texts below the threshold
        w = list(base)
        for _ in range(k // 6):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    for docs in (docs_of(rows), odd):
        assert result(docs) == brute.near_duplicates(brute.rows_of(docs, "doc_id", "text"))


def test_empty_table_and_repeated_rows(docs_of):
    docs = docs_of(["a b c d e f"])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    twice = near_dedup.near_duplicates(docs.unionByName(docs)).collect()
    assert [(r["component_id"], r["kept"]) for r in twice] == [(0, True)] * 2


def test_blocks_find_links_between_components_only():
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(10, 110), np.arange(500, 600)]
    raw = [s.astype(np.uint64).tobytes() for s in sets]
    node, comp, part = np.array([1, 2, 3, 4]), np.array([1, 1, 3, 4]), np.zeros(4, dtype=int)
    assert near_dedup.links_within(node, comp, part, raw) == [(1, 3)]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 9), (9, 1), (7, 8), (8, 8), (1, 5), (20, 7)], "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == [(1, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 1), (20, 7)]
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components(chain).select("component").distinct().collect()[0][0] == 0
    assert components(edges.limit(0)).count() == 0


def test_no_side_of_a_join_passes_through_the_driver(spark, docs_of, monkeypatch):
    """Sides that grow with the corpus are not broadcast, however small they are and whatever the threshold; a row per group of several blocks may be."""
    from cohortlab.llm import common
    from cohortlab.llm import components as graph

    seen, stored = [], common.stored

    def watched(df, label):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    for module in (near_dedup, graph):
        monkeypatch.setattr(module, "stored", watched)
    text = " ".join(f"w{i}" for i in range(40))
    out = near_dedup.near_duplicates(docs_of([f"{text} t{i % 5}" for i in range(20)] + [f"other {i} " * 9 for i in range(9)]))
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.where("NOT kept").count() >= 19
    joins = [line for plan in seen for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert sum("SortMergeJoin" in plan for plan in seen) > 8 and not [line for line in joins if "BroadcastHashJoin [group#" not in line]
