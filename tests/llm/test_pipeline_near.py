"""The pipeline's near-duplicate stage against five-word shingles and a similarity of 0.8."""

import corpus_pipeline


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else ())


def kept(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i for i in sets if find(i) == i}


def test_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, n in enumerate((40, 48, 49, 50, 58, 59)):  # one word replaced in the middle: linked from 49 words on (59 for three words and 0.9)
        own = [f"w{k}x{i}" for i in range(n)]
        rows += [(10**6 + 2 * k, " ".join(own)), (10**6 + 2 * k + 1, " ".join([*own[: n // 2], "other", *own[n // 2 + 1 :]]))]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, made, sf).collect()}
    assert got == kept(rows) and sorted(i - 10**6 for i in got if i >= 10**6) == [0, 1, 2, 3, 4, 6, 8, 10]
