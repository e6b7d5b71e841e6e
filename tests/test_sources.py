"""Sources and sinks: raw CSV contract, Markdown corpus, eval-question JSON, feature parquet round trip."""
import json

import pytest

from cohortlab import constants as C
from cohortlab.operators.chunking import chunk_documents
from cohortlab.sources import tables as tb


def test_raw_csv_contract(spark, tmp_path):
    good = tmp_path / "good.csv"
    header = ",".join(C.RAW_COLUMNS + ["extra"])
    good.write_text(header + "\n" + ",".join(["/a", "A", "", "Apps|Games", "\"1,000\"", "ipo", "USA", "CA", "SF", "SF",
                                             "2", "2005-01-01", "2006-01-01", "2007-01-01", "x"]) + "\n")
    df = tb.read_raw_csv(spark, str(good))
    assert df.columns == C.RAW_COLUMNS
    assert all(f.dataType.simpleString() == "string" for f in df.schema.fields)
    r = df.first()
    assert r.funding_total_usd == "1,000" and r.funding_rounds == "2"
    bad = tmp_path / "bad.csv"
    bad.write_text("permalink,name\n/a,A\n")
    with pytest.raises(ValueError, match="missing expected columns"):
        tb.read_raw_csv(spark, str(bad))


def test_markdown_corpus_and_front_matter(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "b_doc.md").write_text('---\nsource_url: "https://example.org/b"\n---\n\n## One Two\nText here.\n')
    (corpus / "a_doc.md").write_text("---\nsource_url: https://example.org/a\n---\n## Intro\nHello.\n## Next\nMore.\n")
    docs = tb.read_markdown_corpus(spark, str(corpus))
    chunks = chunk_documents(docs).collect()
    got = sorted((c.chunk_id, c.source_url) for c in chunks)
    assert got == [("a_doc::intro", "https://example.org/a"), ("a_doc::next", "https://example.org/a"),
                   ("b_doc::one_two", "https://example.org/b")]


def test_eval_questions_json(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps([{"question": "why do startups fail", "expected_chunk_ids": ["d::failure"]},
                             {"question": "pizza?", "expected_chunk_ids": []}]))
    rows = tb.read_eval_questions(spark, str(p)).collect()
    assert [r.question for r in rows] == ["why do startups fail", "pizza?"]
    assert rows[0].expected_chunk_ids == ["d::failure"] and rows[1].expected_chunk_ids == []


def test_eval_questions_written_as_arrays(spark, tmp_path):
    schema = "question string, expected_chunk_ids array<string>, other int"
    rows = [(f"question {i}?", [f"d{i}::a", "x"] if i % 3 else [], i) for i in range(200)] + [("same", ["y"], 0)] * 50 + [("no ids", None, 1), (None, ["z"], 2)]
    out = tb.write_eval_questions(spark.createDataFrame(rows, schema), str(tmp_path / "q"), per_file=20)
    back = [(r.question, r.expected_chunk_ids) for r in tb.read_eval_questions(spark, out).collect()]
    assert sorted(back, key=repr) == sorted([(q, ids) for q, ids, _ in rows], key=repr)
    files = [json.loads(p.read_text()) for p in (tmp_path / "q").glob("part-*") if p.stat().st_size]
    assert len(files) > 5 and all(isinstance(f, list) for f in files) and max(map(len, files)) < 60
    empty = tb.write_eval_questions(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert tb.read_eval_questions(spark, empty).count() == 0


def test_feature_parquet_partitioned_by_split(spark, sf, tmp_path):
    from cohortlab.plans.q_etl import features_of
    f = features_of(spark, sf)
    path = tb.write_features(f, str(tmp_path))
    back = tb.read_features(spark, path)
    assert back.count() == f.count()
    assert sorted(r.split for r in back.select("split").distinct().collect()) == ["test", "train"]
