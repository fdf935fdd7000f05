import random

import pytest

from quillon.llm import common
from quillon.llm.common import components, hot_join


def brute(edges):
    root = {v: v for e in edges if e[0] != e[1] for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {v: find(v) for v in root}


def of(spark, edges):
    return {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_chain_of_ascending_ids(spark, monkeypatch):
    """A table for each round's hop, one for what is left, one on the way back: few rounds, though the path is long."""
    made, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: made.append(name) or write(df, name))
    assert of(spark, [(i, i + 1) for i in range(1000)]) == dict.fromkeys(range(1001), 0)
    assert len(made) <= 3 * 20


@pytest.mark.parametrize("rows", [common.BROADCAST_ROWS, 0])
def test_against_union_find(spark, monkeypatch, rows):
    """Random graphs, stars and cliques, with broadcast and with salted joins."""
    monkeypatch.setattr(common, "is_small", lambda df, *_: rows > 0)
    rng = random.Random(rows)
    edges = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(130)]
    edges += [(1000, 1000 + i) for i in range(1, 40)] + [(2000 + i, 2000 + j) for i in range(8) for j in range(8)]
    edges += [(1 << 62, -(1 << 62)), (5000, 5000)]
    assert of(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert of(spark, []) == of(spark, [(3, 3)]) == {}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, how):
    left = spark.createDataFrame([(i % 3, i) for i in range(50)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string")
    rows = lambda df: sorted(map(tuple, df.select("k", "v", "w").collect()), key=str)
    assert rows(hot_join(left, right, "k", how, few=False)) == rows(hot_join(left, right, "k", how)) == rows(left.join(right, "k", how))
