"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from fluvia.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.10g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = df.collect()
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    mine = sorted(tuple(normal(r[c]) for c in order) for r in got)
    theirs = sorted(tuple(normal(r[names.index(c)]) for c in order) for r in rows)
    assert len(mine) == len(theirs)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, (order, len(wrong), wrong[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
