"""Every pN_ query with SQL agrees with it on the smallest tables; the others run and give rows."""

import glob
import os

import duckdb
import pytest

from tamarisk.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{small_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return list(map(plain, x)) if isinstance(x, (list, tuple)) else x


def table(rows):
    return sorted((plain(r) for r in map(tuple, rows)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    rows = df.collect()
    assert len(set(map(repr, rows))) == len(rows)
    if name in ORACLES:
        assert table(rows) == table(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())
