"""Every query that has SQL equals it, as bags of rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    con = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(df.columns) == [names[i] for i in order]
    want = [tuple(r[i] for i in order) for r in con.fetchall()]
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
