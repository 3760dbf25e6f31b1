"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and have a stable schema."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from parchwork import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names():
    return sorted(n for m in catalog._modules for n in m.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def told(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr([told(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(told(v) for v in r) for r in df.select(columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(tuple(told(r[i]) for i in at) for r in rel.fetchall())


def test_queries_and_sql_can_be_listed_without_a_session():
    """In a process of its own, as a driver does before it starts Spark."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext; q, s = e.queries(), e.oracle_sql(); assert SparkContext._active_spark_context is None; assert set(s) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 140
