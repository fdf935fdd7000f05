"""Stemmed search: the hits of each row by itself, whatever its length."""

from collections import Counter

from pyspark.sql import functions as F

from quillon.functions.terms import light_stem
from quillon.plans import search as S

ROWS = [(1, "Classes running", "the class runs"), (2, "class", None), (3, None, "run classical running runner RUN"), (4, "", ""), (5, "runn classes", "r"), (None, "class running", "")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_stems(spark):
    t = spark.createDataFrame(ROWS, "id long, a string, b string")
    got = {r.id: (r.doc_len, r.tf) for r in S.counted(t, "id", ["a", "b"], ["runn", "class", "runn"], "ascii", F.lit(True), "light").collect()}
    for i, *texts in ROWS:
        own = [Counter(map(light_stem, (x or "").lower().split())) for x in texts]
        assert got[i] == (sum(c.total() for c in own), [[c[w] for c in own] for w in ("runn", "class")]), i


def test_stemmed_search(spark):
    t = spark.createDataFrame(ROWS, "id long, a string, b string")
    found = S.search(t, "id", ["a", "b"], "running classes", limit=None, stem="light").collect()
    assert {r.id: (r.hits, r.doc_len, r.column_hits) for r in found} == {1: (3, 5, [2, 1]), 3: (3, 5, [0, 3]), 5: (2, 3, [2, 0])}
    assert {r.id for r in S.search(t, "id", ["a", "b"], "running classes", stem="light", filters=("id>=2",)).collect()} == {3, 5}
    stats = S.search_stats(t, "id", ["a", "b"], "running classes", stem="light").first()
    assert (stats.total_rows, stats.rows_with_term, stats.total_hits) == (6, 3, 8)


def test_no_row_for_each_word(spark):
    """A row for each word, each with all words of its document beside it, took disk with the square of a text's length."""
    t = spark.createDataFrame(ROWS, "id long, a string, b string")
    plan = plan_of(S.search(t, "id", ["a", "b"], "running", stem="light"))
    assert "Generate" not in plan and "EvalPython" not in plan and "Join Inner" not in plan
