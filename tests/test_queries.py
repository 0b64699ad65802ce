"""Every query with SQL, at the smallest scale, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, canonical, close

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns, rows = canonical(df.columns, df.collect())
    cur = duck.execute(ORACLES[name])
    want_columns, want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert columns == want_columns
    assert len(rows) == len(want)
    assert all(close(a, b) for a, b in zip(rows, want))


def test_entry_has_findings(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
