"""Every query that has DuckDB SQL gives the same rows by both engines, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted([tuple(show(r[i]) for i in at) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(got.fetchall(), columns)


def test_every_query_is_checked():
    open_ = set(__spark_entry__.queries()) - set(SQL)
    assert all(k.startswith("op") or k == "pipeline" for k in open_), open_
