"""ETL contracts and traps on tiny frames (labels, coercion, dates, split, bands)."""
import pytest
from pyspark.sql import functions as F

from cohortlab import constants as C
from cohortlab.functions.columns import age_band, funding_band
from cohortlab.operators import features as fe
from cohortlab.sources.tables import RAW_SCHEMA


def _raw(spark, rows):
    full = []
    for r in rows:
        d = {c: None for c in C.RAW_COLUMNS}
        d.update(r)
        full.append(tuple(d[c] for c in C.RAW_COLUMNS))
    return spark.createDataFrame(full, RAW_SCHEMA)


BASE = [
    {"permalink": "/a", "name": "A", "status": "acquired", "category_list": "Apps|Games", "funding_total_usd": "1,000,000",
     "funding_rounds": "2", "founded_at": "2005-01-01", "first_funding_at": "2006-01-01", "last_funding_at": "2008-01-01",
     "country_code": "USA"},
    {"permalink": "/b", "name": "B", "status": "closed", "category_list": None, "funding_total_usd": "-",
     "funding_rounds": "1", "founded_at": "1015-01-30", "first_funding_at": "2007-03-01", "last_funding_at": "2007-03-01"},
    {"permalink": "/c", "name": "C", "status": "operating", "category_list": "Web", "funding_total_usd": "500000",
     "funding_rounds": "3", "founded_at": "2010-01-01", "first_funding_at": "2011-01-01", "last_funding_at": "2012-01-01"},
    {"permalink": "/d", "name": "D", "status": "ipo", "category_list": "Bio", "funding_total_usd": "250000000",
     "funding_rounds": "4", "founded_at": "2914-01-01", "first_funding_at": "2009-06-01", "last_funding_at": "2012-06-01"},
]


def test_labels_and_operating_dropped(spark):
    out = fe.label_and_filter(_raw(spark, BASE)).select("permalink", "label").orderBy("permalink").collect()
    assert [(r.permalink, r.label) for r in out] == [("/a", 1), ("/b", 0), ("/d", 1)]


def test_unknown_status_raises(spark):
    rows = BASE + [{"permalink": "/z", "status": "zombie", "funding_rounds": "1"}]
    with pytest.raises(Exception, match="status not in the label vocabulary"):
        fe.label_and_filter(_raw(spark, rows)).collect()
    assert [r.status for r in fe.unknown_statuses(_raw(spark, rows)).collect()] == ["zombie"]


def test_null_status_raises(spark):
    rows = BASE + [{"permalink": "/n", "status": None, "funding_rounds": "1"}]
    with pytest.raises(Exception, match="status not in the label vocabulary"):
        fe.label_and_filter(_raw(spark, rows)).collect()


def test_funding_coercion_and_garbage(spark):
    raw = _raw(spark, BASE)
    vals = raw.select("permalink", fe.funding_usd(F.col("funding_total_usd")).alias("usd")).orderBy("permalink").collect()
    assert [v.usd for v in vals] == [1_000_000.0, None, 500_000.0, 250_000_000.0]
    bad = _raw(spark, BASE + [{"permalink": "/x", "status": "closed", "funding_total_usd": "not-a-number"},
                              {"permalink": "/y", "status": "closed", "funding_total_usd": "5d"}])
    with pytest.raises(ValueError, match="2 unparseable values"):
        fe.assert_funding_parseable(bad)
    with pytest.raises(Exception, match="unparseable"):
        bad.select(fe.funding_usd(F.col("funding_total_usd"))).collect()


def test_features_dates_and_split(spark):
    f = fe.build_features(_raw(spark, BASE), test_quantile=0.5, keep_dates=True).orderBy("permalink").collect()
    by = {r.permalink: r for r in f}
    # garbage founding years fall back to the first funding date
    assert by["/b"].founded_year == 2007.0 and by["/b"].time_to_first_funding_days is None
    assert by["/d"].founded_year == 2009.0
    assert by["/a"].time_to_first_funding_days == 365.0 and by["/a"].funding_span_days == 730.0
    assert by["/a"].primary_category == "Apps" and by["/b"].primary_category is None
    train = [r.effective_date for r in f if r.split == "train"]
    test = [r.effective_date for r in f if r.split == "test"]
    assert max(train) < min(test)  # no date overlap


def test_leakage_guard():
    from cohortlab.operators.modeling import leakage_guard
    with pytest.raises(ValueError):
        leakage_guard(["founded_year", "funding_rounds"], "clean")
    leakage_guard(C.CLEAN_NUMERIC_FEATURES + C.CLEAN_CATEGORICAL_FEATURES, "clean")


def test_bands_edges(spark):
    df = spark.createDataFrame([(0.0,), (100000.0,), (100000.01,), (1e8,), (2e8,), (None,)], "usd double")
    got = [r[0] for r in df.select(funding_band(F.col("usd"))).collect()]
    assert got == [None, "<$100K", "$100K-$1M", "$10M-$100M", "$100M+", None]
    ages = spark.createDataFrame([(0.0,), (2.0,), (4.9,), (20.0,)], "a double")
    assert [r[0] for r in ages.select(age_band(F.col("a"))).collect()] == ["0-2y", "2-5y", "2-5y", "20y+"]
