"""Queries for training data against their SQL in DuckDB, on all rows of the smallest tables."""

import os

import duckdb
import pytest

from lodecast.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in os.listdir(tiny):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{t}'")
    plain = lambda v: round(v, 8) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    df = queries.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    q = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in q.description].index(c) for c in cols]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in at)) for r in q.fetchall())
