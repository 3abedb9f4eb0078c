"""Every registered query against its SQL twin, and the shape of the contract."""

import duckdb
import os
import pytest

import __spark_entry__ as entry
from tools.check import table

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        part = "/*.parquet" if os.path.isdir(f"{folder}/{f}") else ""
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}{part}'")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in set(QUERIES) - set(ORACLES) if n != "pipeline" and not n.startswith("op")]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "health_status" in df.columns


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "pipeline" and not n.startswith("op")))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        answer = duck.execute(ORACLES[name])
        columns = [d[0] for d in answer.description]
        assert got == table(columns, answer.fetchall())
    else:
        assert got[1]
