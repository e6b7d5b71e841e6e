"""Every query with oracle SQL gives the same rows on Spark and in DuckDB, with uniquely named columns."""
import duckdb
import pytest

import __spark_entry__ as E
from cohortlab.sources.tables import DRIVER_TABLES
from tools.oracle_check import close, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n != "pipeline" and not n.startswith("op")))
def test_query_matches_its_oracle(spark, con, name):
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    assert len(cols) == len(set(cols))
    df = E.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))
