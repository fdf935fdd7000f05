"""The registered SQL against the queries, on whole tables."""

import duckdb
import pytest

from quillon.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
