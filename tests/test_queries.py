"""Every registered collection query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from dossierflow.plans import ORACLE, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return "null" if v != v else f"{v:.9g}"
        return "null" if v is None or v is pd.NaT or v is pd.NA else str(v)

    return sorted(tuple(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLE:
        want = db.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
