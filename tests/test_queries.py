"""Every registered query runs, and agrees with its SQL, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return None if x != x else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{small_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("p")) + [n for n in sorted(QUERIES) if n.startswith("p") and not n[1].isdigit()])
def test_query(spark, con, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    rows = table(df.collect(), df.columns)
    if name in SQL:
        want = con.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows == table(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
