"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import math

import duckdb
import pandas as pd
import pytest

from strandloom.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def canon(frame):
    frame = frame[sorted(frame.columns)].astype(object)

    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, D).toPandas()
    sql = registry.oracles().get(name)
    if sql is None:
        assert len(got)
        return
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
