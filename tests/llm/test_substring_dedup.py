import hashlib
import random

import pytest

from quillon.llm.substring_dedup import COVERS, drop_repeated_passages, op10_substring_dedup


def brute(rows, window=50):
    """doc_id -> (words, removed, kept)"""
    rows = {i: (t or "") for i, t in rows}
    words = {i: t.encode().split() for i, t in rows.items()}
    least = {}
    for i in sorted(k for k in words if k is not None):
        for p in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept_text)) for r in df.collect()}


@pytest.mark.parametrize("period", COVERS)
def test_covers(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)] + ["Ä", "x y"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 70, 120)]
    rows = []
    for i in range(120):
        w = text(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        if rows and rng.random() < 0.15:
            w = rng.choice(rows)[1].split(" ")
            if rng.random() < 0.5 and len(w) > 5:
                w[rng.randrange(len(w))] = "edit"
        rows.append((rng.randrange(10**9) * 1000 + i, rng.choice([" ", " "]).join(w)))
    rows += [(-5, None), (-6, ""), (-7, " \t\n "), (-8, "one " * 300), (-9, "one " * 120), (-10, "one " * 49), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(drop_repeated_passages(df)) == brute(rows)


def test_repeated_rows_and_empty(spark):
    t = " ".join(map(str, range(80)))
    df = spark.createDataFrame([(1, t, 3), (1, t, 3), (2, t, 4)], "doc_id long, text string, ranges int")
    assert sorted((r.doc_id, r.n_removed) for r in drop_repeated_passages(df).collect()) == [(1, 0), (1, 0), (2, 80)]
    assert drop_repeated_passages(df.limit(0)).collect() == []


def test_several_texts_of_an_id(spark):
    """Five documents, seven rows: each by its own text; texts of one id don't repeat each other."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, f"x {b}"), (3, f"y {b}"), (3, c), (-9, f"{c} z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text).decode()) for r in drop_repeated_passages(df).collect())
    assert got == [(-9, 81, 0, f"{c} z"), (1, 80, 0, a), (2, 80, 0, b), (2, 80, 80, ""), (2, 81, 0, f"x {b}"), (3, 80, 80, ""), (3, 81, 80, "y")]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, r, hashlib.sha256(k).hexdigest()) for i, (n, r, k) in brute(rows).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op10_substring_dedup(spark, sf).collect()} == want
