"""Every query with an oracle, against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from studyloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.5f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(shown, r)) for r in df.select(columns).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(shown, r)) for r in duck.sql(f"select {names} from ({catalogue.ORACLES[name]})").fetchall())
    assert ours == theirs


def test_all_queries_have_oracles():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
