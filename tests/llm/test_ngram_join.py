import random

import pytest

from quillon.llm import ngram_join
from quillon.llm.ngram_join import jaccard_groups, op5_ngram_jaccard


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else ())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i in ids:
        by.setdefault(sets[i], []).append(i)
    reps = [(v[0], s) for s, v in by.items() if s]
    for v in [v for s, v in by.items() if s]:
        for x in v[1:]:
            parent[find(x)] = find(v[0])
    for k, (a, x) in enumerate(reps):
        for b, y in reps[:k]:
            if min(len(x), len(y)) * 10 >= 9 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), min(j for j in ids if find(j) == find(i)) if len(ids) < 3000 else find(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rng = random.Random(block)
    vocab = [f"W{i}" for i in range(300)]
    common = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90]))] + (common if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.randrange(4) if len(w) > 4 else 0):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["edit"], [w[at], "more"]])
            rows.append((rng.randrange(10**9) * 1000 + len(rows), "\t".join(rng.choice([str.lower, str])(x) for x in w)))
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "one"), (-5, "ONE "), (-6, "one two"), (-7, "Ä É x"), (-8, "ä é x"), (-9, "a b " * 500), (-10, "a b " * 700), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard_groups(df)) == brute(rows) | {None: (2, None)}


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d", 1), (3, "a b c d", 1), (2, "A b c  d", 1)], "doc_id long, text string, gram int")
    assert sorted(jaccard_groups(df).collect()) == [(2, 2, 2), (3, 2, 2), (3, 2, 2)]
    assert jaccard_groups(df.limit(0)).collect() == []


def test_several_texts_of_an_id(spark):
    """A doc_id with several texts links by any of them, each row counts its own; texts without words link with nothing."""
    rows = [(7, "a b c d"), (3, "A b c d"), (3, "e f g h i"), (9, "e f g h i"), (5, "e f g h i"), (4, ""), (9, None), (6, " \n"), (8, " \n"), (2, "k l m"), (2, "k l m")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(2, 1, 2), (2, 1, 2), (3, 2, 3), (3, 3, 3), (4, 0, 4), (5, 3, 3), (6, 0, 6), (7, 2, 3), (8, 0, 8), (9, 0, 3), (9, 3, 3)]
    assert sorted(map(tuple, jaccard_groups(df).collect())) == want


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op5_ngram_jaccard(spark, sf)) == brute(rows)
