"""Each stage against its brute-force version, on its own input."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlab.llm import language, mixing
from cohortlab.llm.common import held_out, table

import brute


@pytest.fixture(scope="module")
def chain(spark, sf):
    docs, out = table(spark, sf, "documents").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stage_columns(chain, spark, sf):
    want = table(spark, sf, "documents").columns
    assert [n for n, _, _ in chain] == ["language_id", "near_dedup", "decontamination", "secret_scan", "source_mix"]
    assert all(after.columns == want for _, _, after in chain[:-1])


def test_language_stage_keeps_documents_in_a_language(chain, spark, sf):
    _, docs, after = chain[0]
    model = language.fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    assert ids(after) == ids(language.predict(docs, model).where("lang_pred <> 'und' AND NOT ambiguous"))
    assert after.count() >= 0.99 * docs.count()


def test_near_dedup_stage(chain):
    _, docs, after = chain[1]
    groups = brute.near_duplicates(brute.rows_of(docs, "doc_id", "text"))
    assert ids(after) == {d for d, (_, c) in groups.items() if d == c} and after.count() == len(ids(after))


def test_decontamination_stage(chain, spark, sf):
    _, docs, after = chain[2]
    found = brute.contamination(brute.rows_of(docs, "doc_id", "text"), brute.rows_of(table(spark, sf, "benchmark"), "item_id", "text"))
    assert ids(after) == {d for d, (_, n, _) in found.items() if not n}


def test_secret_stage(chain):
    _, docs, after = chain[3]
    before, now = dict(brute.rows_of(docs, "doc_id", "text")), dict(brute.rows_of(after, "doc_id", "text"))
    assert before.keys() == now.keys()
    for d, t in before.items():
        assert not brute.base_spans(now[d].replace("[SECRET]", "\n"))
        assert now[d] == t or "[SECRET]" in now[d]
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_mix_stage(chain):
    _, docs, after = chain[4]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(docs).collect() if r["taken"]}
    assert {r["doc_id"]: r["w"] for r in after.groupBy("doc_id").agg(F.sum("words").alias("w")).collect()} == taken


def test_run_and_odd_tables(spark, sf, odd, chain):
    assert corpus_pipeline.run(spark, sf).count() == chain[4][2].count()
    for docs in (odd, odd.limit(0), odd.unionByName(odd)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, sf)
            if name != "source_mix":
                assert after.columns == odd.columns
            docs = after
        assert after.count() >= 0
