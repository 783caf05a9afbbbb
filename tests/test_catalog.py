"""Every query with SQL gives the rows that DuckDB gives, and the others run, on the smallest tables."""

import os
import sys

import duckdb
import pytest

from kbspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(spark_rows, columns, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in spark_rows)
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert a == b


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalog.ORACLES:
        same(rows, df.columns, duck, catalog.ORACLES[name])
    else:
        assert rows


def test_entry_point():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
