"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from folioframe import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def clean(v):
        if isinstance(v, float):
            return round(v, 6) if math.isfinite(v) else str(v)
        if isinstance(v, (bytes, bytearray)):
            return bytes(v)
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, df, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, con, name):
    compare(spark, con, catalog.Q[name](spark, SF), catalog.SQL[name])


def test_every_query_has_sql():
    assert set(catalog.Q) == set(catalog.SQL)
