"""Sections cut in parallel blocks give the chunks of the sequential rule."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import chunking as ch
from tests.test_text import oracle_chunks


def _sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(n)) + rng.choice(".!?")


def _body(rng, n, longest):
    return rng.choice([" ", "\n", "  "]).join(_sentence(rng, rng.choice([1, 1, 2, rng.randint(1, longest)])) for _ in range(n))


@pytest.mark.parametrize("target, overlap, limit, block", [(20, 5, 40, 25), (20, 19, 40, 40), (7, 12, 10, 19), (30, 4, 60, 61)])
def test_blocks_match_the_sequential_rule(spark, target, overlap, limit, block):
    rng = random.Random(5)
    texts = [f"## A b\n{_body(rng, rng.randint(1, 300), rng.choice([1, 3, 12, 60]))}\n## C\n{_body(rng, rng.randint(1, 200), 9)}" for _ in range(12)]
    texts += ["## Run on\n" + " ".join(f"w{i}" for i in range(n)) for n in (701, 3000)]
    texts += [texts[0], "", "## Empty\n", None]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] * 2, "doc_id string, text string")  # every row twice
    got = ch.chunk_documents(docs, target=target, overlap=overlap, max_section_words=limit, block=block).select("chunk_id", "heading", "text").collect()
    want = [c for i, t in enumerate(texts) if t is not None for c in oracle_chunks(t, str(i), None, target, overlap, limit)] * 2
    assert sorted(map(tuple, got)) == sorted(want)


def test_transition_is_the_fold_from_every_state():
    rng = np.random.default_rng(3)
    for states, top in ((1, 3), (9, 4), (17, 40)):
        counts = rng.integers(1, top, 60)
        since, cuts = ch.transition(counts, states)
        for d in range(states):
            words, made = d, 0
            for c in counts:
                words += c
                if words >= states:
                    words, made = 0, made + 1
            assert (since[d], cuts[d]) == (words, made)


def test_blocks_must_hold_what_a_chunk_reaches_back_to(spark):
    docs = spark.createDataFrame([("1", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="at least"):
        ch.chunk_documents(docs, block=100)


def test_section_of_a_million_sentences(spark):
    n = 1_000_000
    text = "## Huge\n" + " ".join(f"s{i}" + " x" * (i % 4) + "." for i in range(n))
    docs = spark.createDataFrame([("1", text)], "doc_id string, text string")
    chunks = ch.chunk_documents(docs)
    got = [r.text for r in chunks.where(F.col("n_pieces") > 1).orderBy("piece_idx").select("text").collect()]
    assert got == [t for _, _, t in oracle_chunks(text, "1")]
