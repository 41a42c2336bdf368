"""Every query with SQL gives the rows of its SQL on the smallest tables; the entry point runs; corpus
operators are optional."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from wayfare import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = db.execute(catalog.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, df.select(*columns).collect())) == sorted(repr(_row(columns, r)) for r in cur.fetchall())


def _row(columns, values):
    from pyspark.sql import Row

    return Row(*columns)(*values)


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry_and_without_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in ("wayfare", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(root / p)
    code = "import sys; sys.modules['wayfare.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
