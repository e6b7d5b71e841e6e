import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """documents from (text, lang, source) rows, numbered from 0, with extra columns of clashing names."""

    def make(rows, extra=True):
        rows = [(i, *(r if isinstance(r, tuple) else (r, "en", "a"))) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], SCHEMA)
        clashes = ("row", "n", "u", "v", "node", "key", "place", "symbol", "spans", "hits", "size", "words", "shard", "copy", "count", "_id", "h", "start")
        return df.select("*", *[F.lit("x").alias(c) for c in clashes]) if extra else df

    return make


@pytest.fixture
def odd(docs_of):
    """Nulls, empty and blank texts, a very long one, ties and copies."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
    return docs_of([None, "", " \n\t ", "one", "one two three four", "One two three four", long, long + " tail", ("a b c d e f g", None, None), ("12 34 --", "en", "b"),
                    ("alpha beta " * 30, "en", "b"), ("alpha beta " * 30, "en", None), ("x\ny\nx\nx\n", "fr", "c")])
