"""Every query with a SQL counterpart gives the same rows in both engines."""

import math

import duckdb
import pytest

from tracelode.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def clean(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_same_rows(spark, db, key):
    df = catalog.QUERIES[key](spark, DATA)
    found = db.execute(catalog.ORACLES[key])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted((tuple(clean(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted((tuple(clean(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_every_query_without_sql_runs(spark):
    for key in sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()):
        catalog.QUERIES[key](spark, DATA).collect()
