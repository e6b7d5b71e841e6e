"""Rows that share a doc_id or have none, and workers that do not have the package."""
import os
import random
import subprocess
import sys
from collections import Counter

from cohortlab.llm import decontaminate, language, mixing, near_dedup, quality_model, quality_rules, recompress, secrets

import brute

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows():
    rng = random.Random(5)
    word = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    passage, other = word(40), word(60)
    texts = [(1, word(150) + passage + word(150)), (1, word(11)), (1, word(20) + other + word(20)), (2, passage + word(5)), (2, word(3) + passage + word(9)), (2, word(3)), (3, other + word(400)), (3, word(12)), (4, other),
             (None, word(7) + passage), (None, other + word(9)), (5, passage + other), (5, passage + other)]
    return [(i, " ".join(t)) for i, t in texts] + [(6, None), (6, ""), (6, " ".join(other)), (None, None)], " ".join(passage)


def frame(spark):
    found, passage = rows()
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in found], "doc_id long, text string, lang string, source string, n_chars long"), passage


def test_contamination_is_by_row(spark):
    docs, passage = frame(spark)
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect())
    want = Counter()
    for i, t in rows()[0]:
        n, hit, _ = brute.contamination([(0, t)], [(7, passage)])[0]
        want[(i, n, hit)] += 1
    assert got == want and sum(n for (_, _, hit), n in want.items() if hit) == 6


def test_repeats_are_by_row(spark):
    docs, _ = frame(spark)
    found, _ = rows()
    first = {}
    for i, t in found:
        w = brute.SPACED.findall(t or "")
        for j in range(len(w) - 12):
            if i is not None:
                first[tuple(w[j : j + 13])] = min(first.get(tuple(w[j : j + 13]), i), i)
    want = Counter()
    for i, t in found:
        w, gone = brute.SPACED.findall(t or ""), set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        want[(i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert Counter(tuple(r) for r in recompress.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()) == want
    assert sum(n for (_, _, g, _), n in want.items() if g) >= 6


def test_other_operators_keep_a_row_each(spark):
    docs, _ = frame(spark)
    n = docs.count()
    assert language.identify(docs).count() == n
    assert secrets.find_secrets(docs).count() == n
    assert quality_rules.judged(docs).count() == n
    assert quality_model.quality_scores(docs, spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")).count() == n
    assert mixing.mixed_sizes(docs).count() == n
    assert near_dedup.near_duplicates(docs).where("doc_id IS NOT NULL").select("doc_id").distinct().count() == 6


def test_models_reach_workers_without_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from cohortlab.session import get_session
spark = get_session(master="local[2]", shuffle_partitions=2)
from cohortlab.llm import queries
import corpus_pipeline
sf = "/root/testdata/sf0.001"
for q in ("op1_language_id", "op6_quality_model", "op8_secret_scan"):
    assert queries.QUERIES[q](spark, sf).count() == 200, q
assert corpus_pipeline.run(spark, sf).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
