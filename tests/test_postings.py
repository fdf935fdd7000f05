"""Postings of an index: each row's words by themselves, without a shuffle."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from quillon.functions import terms
from quillon.plans import search as S

ROWS = [(7, "The cat, the class", "classes the"), (8, None, ""), (9, "--", "runs running RUN"), (None, "the", "x"), (10, "a b a b a", None)]


def brute(rows, stem="none"):
    out = defaultdict(list)
    for key, *texts in rows:
        for col, text in enumerate(texts):
            words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
            for at, w in enumerate(words):
                out[terms.light_stem(w) if stem == "light" else w, key, col].append(at)
    return {(*k, len(v), tuple(v)) for k, v in out.items()}


def test_postings(spark):
    t = spark.createDataFrame(ROWS, "id long, a string, b string")
    for stem in ("none", "light"):
        p = S.postings(t, "id", ["a", "b"], stem)
        assert p.dtypes == [("term", "string"), ("id", "bigint"), ("col", "int"), ("tf", "bigint"), ("positions", "array<int>")]
        got = [(*r[:4], tuple(r.positions)) for r in p.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(ROWS, stem)
    assert S.postings(t.limit(0), "id", ["a", "b"]).collect() == []


def test_no_shuffle(spark):
    """A row for each word went to a shuffle and, beyond 128 groups a task, to a sort that spills."""
    plan = S.postings(spark.createDataFrame(ROWS, "id long, a string, b string"), "id", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Aggregate", "Sort", "Generate"))


def test_cuts_of_a_batch(monkeypatch):
    """Rows longer than a cut, and empty ones at its borders."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, int(n)))) for i, n in enumerate([0, 5, 300, 0, 0, 99, 1, 100, 0, 40, 700, 0])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([x.split() for _, x in rows], pa.list_(pa.string()))], names=["id", "_0"])
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(terms, "WORDS_AT_ONCE", size)
        got = [tuple(r.values()) for b in terms.unblock(terms.post(iter([batch.slice(1), batch.slice(0, 1)]), "none"), "id") for r in b.to_pylist()]
        assert len(got) == len(set(x[:3] for x in got)) and {(*x[:4], tuple(x[4])) for x in got} == brute(rows)


def test_search_over_a_stemmed_index(spark, tmp_path):
    t = spark.createDataFrame([r for r in ROWS if r[0]], "id long, a string, b string")
    S.save_index(t, "id", ["a", "b"], str(tmp_path / "index"), "light")
    for q in ("class", "the classes", "run"):
        by_index, plain = (S.search(t, "id", ["a", "b"], q, stem="light", index=i).collect() for i in (str(tmp_path / "index"), None))
        assert [r.id for r in by_index] == [r.id for r in plain] and [(r.hits, r.doc_len, r.column_hits) for r in by_index] == [(r.hits, r.doc_len, r.column_hits) for r in plain] and len(plain)
