"""Every query that has SQL equals it on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from stratasift.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else format(float(v), ".9g")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_equals_sql(spark, duck, name):
    df = all_queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(all_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(spark, name):
    df = all_queries()[name](spark, SF)
    found = df.collect()
    assert found and all(len(r) == len(df.columns) for r in found)
