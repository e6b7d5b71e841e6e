"""The index and retrieval shuffle a row per chunk, the postings of rare terms and each partition's best, not every posting."""
import math
from collections import Counter, defaultdict

import pytest

from cohortlab.functions.text import tokens
from cohortlab.operators import retrieval as rt

TEXTS = {"a": "alpha beta gamma alpha", "b": "beta delta epsilon", "c": "gamma zeta zeta eta", "d": "alpha eta theta", "e": "", "f": None}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(k, k, 0, i, t) for i, (k, t) in enumerate(TEXTS.items())], "chunk_id string, doc_id string, sec_idx int, piece_idx int, text string")


@pytest.mark.parametrize("common", [1 << 16, 2, 1])
def test_weights_do_not_depend_on_which_terms_are_common(spark, chunks, monkeypatch, common):
    monkeypatch.setattr(rt, "COMMON", common)
    postings, idf = rt.build_index(chunks)
    got = defaultdict(dict)
    for r in postings.collect():
        got[r["chunk_id"]][r["term"]] = r["weight"]
    counts = {r["chunk_id"]: Counter(r["t"]) for r in chunks.where("text IS NOT NULL").select("chunk_id", tokens(chunks["text"]).alias("t")).collect()}
    df = Counter(t for c in counts.values() for t in c)
    assert {r["term"]: r["df"] for r in idf.collect()} == df
    for chunk, c in counts.items():
        w = {t: n * (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        assert got[chunk].keys() == w.keys() and all(abs(got[chunk][t] - x / norm) < 1e-12 for t, x in w.items())


def test_postings_are_not_shuffled_again(chunks):
    """One exchange deals the stored rows, one the rare terms by chunk; the norms' window adds none."""
    postings, _ = rt.build_index(chunks)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk_id") == 2
    window = plan[plan.index("Window"):]
    assert "Exchange" not in window[:window.index("Union")]


def test_padding_keeps_scores_and_repeated_chunks(spark, chunks):
    postings, idf = rt.build_index(chunks)
    q = spark.createDataFrame([(1, "theta"), (2, "nothing here")], "qid int, question string")
    twice = chunks.unionByName(chunks.where("chunk_id = 'd'"))
    top = defaultdict(list)
    for r in sorted(rt.retrieve(q, twice, postings, idf, 4).collect(), key=lambda r: r["rank"]):
        top[r["qid"]].append((r["chunk_id"], r["score"] > 0))
    assert top[1] == [("d", True), ("d", True), ("f", False), ("e", False)]
    assert [c for c, _ in top[2]] == ["f", "e", "d", "d"] and not any(s for _, s in top[2])
