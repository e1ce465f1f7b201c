"""Every registered query of the engine against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from lexmill import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    at = [[x[0] for x in found.description].index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[k] for k in at) for r in found.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_binary_roundtrip(spark):
    got = {tuple(r) for r in queries.QUERIES["binary_roundtrip"](spark, DATA).collect()}
    assert got == {tuple(r) for r in queries.QUERIES["postings"](spark, DATA).select("term", "doc_id").collect()}
