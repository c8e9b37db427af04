"""Every query of the library against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from riskweave import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def text(value) -> str:
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    result = duck.sql(core.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    mine = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    names = result.columns
    theirs = sorted(tuple(text(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())
    assert mine == theirs


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLES)


def test_import_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
