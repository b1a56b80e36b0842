"""Every query that has SQL gives its rows, at the smallest scale."""

import collections
import datetime
import decimal
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


# queries of the optional subpackage have their own tests
OWN = [n for n in sorted(entry.oracle_sql()) if not re.match(r"op\d|pipeline", n)]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = collections.Counter(tuple(map(plain, r)) for r in got.select(columns).collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_every_query_has_sql_or_is_listed():
    without = {n for n in entry.queries() if n not in entry.oracle_sql() and not re.match(r"op\d|pipeline", n)}
    assert not without


def test_entry(spark):
    assert entry.entry(spark).count() > 0
