"""The training-data queries that SQL can express, against it."""

import glob
import os

import duckdb
import pytest

from tidelog.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    res = con.execute(queries.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())
