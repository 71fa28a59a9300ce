import duckdb
import pytest

import __spark_entry__ as entry
from quantloom import queries as q

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "events", "lineitem")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "timestamp", "returns_1d", "sma_20", "rsi_14"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(q.ORACLES) >= 60


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(q.ORACLES[name])
    assert sorted(want.columns) == cols
    picked = ", ".join(f'"{c}"' for c in cols)
    rows = db.sql(f"SELECT {picked} FROM ({q.ORACLES[name]}) q").fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_other_queries_run(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
