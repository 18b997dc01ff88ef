"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toArrow(), db.sql(__spark_entry__.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(str([r[c] for c in columns]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200


def test_all_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
