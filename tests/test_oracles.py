"""Every query with SQL, on the smallest tables, against DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    if isinstance(x, bool) or x is None:
        return str(x)
    return f"{float(x):.6f}" if isinstance(x, int) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    names = sorted(got.columns)
    rows = sorted([plain(r[c]) for c in names] for r in got.collect())
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    expected = sorted([plain(r[i]) for i in order] for r in want.fetchall())
    assert len(rows) == len(expected)
    assert rows == expected


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"))
def test_query_without_sql_runs(spark, name):
    rows = entry.queries()[name](spark, DATA).collect()
    assert rows and any(v is not None for r in rows for v in r)
