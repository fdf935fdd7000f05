"""Every query of the engine against the same question in SQL, on whole tables."""

import duckdb
import pandas as pd
import pytest

from quillon.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def key(r):
    return tuple((v is None, str(v)) for v in r)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got.columns) and len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda f: sorted((tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)), key=key)
    assert norm(got) == norm(want)
