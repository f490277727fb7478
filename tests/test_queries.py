import datetime
import decimal

import __spark_entry__
import duckdb
import pytest
from inkstone import registry

SMALL = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in (*registry.TABLES, "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if sql])
def test_equals_sql(spark, duck, name):
    run, sql = registry.QUERIES[name]
    got = run(spark, SMALL)
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(want.columns)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=key)
    b = sorted((tuple(plain(x) for x in r) for r in want.project(", ".join(f'"{c}"' for c in names)).fetchall()), key=key)
    assert a == b and (a or name in ("compact_quote",))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
