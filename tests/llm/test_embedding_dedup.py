import numpy as np

from quillon.llm import embedding_dedup
from quillon.llm.embedding_dedup import near_vectors, op9_embedding_dedup, plan


def brute(ids, x, cosine=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(linked, label, 1 << 60).min(axis=1))
        if (new == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), label, strict=True)}
        label = new


def got(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def recall(got, want):
    return sum(g[0] for g in got.values()) / all_ if (all_ := sum(w[0] for w in want.values())) else 1.0


def make(rng, n, dim=16):
    x = rng.standard_normal((n, dim))
    for _ in range(n // 2):
        i, j = rng.integers(n, size=2)
        x[i] = x[j] + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.1, 0.3])
    return x


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", 32)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 20)
    rng = np.random.default_rng(5)
    x = make(rng, 700)
    ids = [int(i) for i in rng.permutation(10_000)[:700]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    g, w = got(near_vectors(df)), brute(ids, x)
    assert set(g) == set(w) and all(g[i][0] <= w[i][0] for i in w) and recall(g, w) >= 0.97


def test_recall_at_the_limit(spark):
    """20,000 vectors, production constants, 128 buckets: pairs of a cosine between 0.9 and 0.93 only, none false."""
    rng, n, dim = np.random.default_rng(8), 20_000, 64
    x = rng.standard_normal((n, dim))
    for i in range(0, 3000, 2):  # a pair of each two, at a chosen angle
        c = rng.uniform(0.9, 0.93)
        u = x[i] / np.linalg.norm(x[i])
        v = x[i + 1] - (x[i + 1] @ u) * u
        x[i + 1] = c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)
    assert plan(n, 0.9, 48, 0.98)[:2] == (7, 10)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    g = got(near_vectors(df))
    hit = sum(g[i + 1] == (1, i) for i in range(0, 3000, 2))
    assert hit >= 0.95 * 1500 and sum(k for k, _ in g.values()) == 2 * hit


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, []), (11, [-1.0, 0.0]), (12, [0.0, 1e300]), (13, [1e298, 1e300]), (14, [-9.0, 0.0, 1.0]), (14, [9.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = near_vectors(df).collect()
    g = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows) and g[1] == (2, 1, True) and g[2] == (2, 1, False) and g[8] == (2, 1, False) and g[None] == (0, None, None)
    assert all(g[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 9, 10, 11, 14)) and g[12] == (1, 12, True) and g[13] == (1, 12, False)
    assert near_vectors(df.limit(0)).collect() == []


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    g, w = got(op9_embedding_dedup(spark, sf)), brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64))
    assert all(g[i][0] <= w[i][0] for i in w) and recall(g, w) >= 0.95
