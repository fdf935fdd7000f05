"""A task of the search for leaks works on pieces of its batches: its memory doesn't follow the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import decontaminate as D

WORDS = [b"w%d" % i for i in range(400)]
PLACE = {w: i for i, w in enumerate(WORDS)}


def texts(n: int) -> pa.RecordBatch:
    rng = np.random.default_rng(4)
    rows = [b" ".join(WORDS[k] for k in rng.integers(0, 400, int(rng.integers(0, 400)))) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "text"])


def tasks(batch: pa.RecordBatch) -> dict:
    rng = np.random.default_rng(5)
    idf, basis = rng.random(400) + 1, rng.standard_normal((400, 144))
    own = [tuple(WORDS[k] for k in rng.integers(0, 400, 12)) for _ in range(20)]
    items = [D.Item(i, x, frozenset(x[:3]), frozenset(x)) for i, x in enumerate(own)]
    points = rng.standard_normal((20, 128)).astype(np.float32)
    model = D.Latent(PLACE, idf, basis[:, :128].astype(np.float32), points / np.linalg.norm(points, axis=1)[:, None])
    anchors = D.anchors_of(items, PLACE, idf)
    coded = pa.Table.from_batches(list(D.encode(iter([batch]), PLACE))).combine_chunks().to_batches()
    hits = pa.array([[{"item": k % 20, "half": 0, "cosine": None} for k in range(3)]] * batch.num_rows, pa.list_(pa.struct([("item", pa.int32()), ("half", pa.int32()), ("cosine", pa.float64())])))
    found = pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, "hits"])
    return {
        "count_terms": lambda: D.count_terms(iter([batch]), PLACE), "encode": lambda: D.encode(iter([batch]), PLACE), "gram_times": lambda: D.gram_times(iter(coded), idf, basis),
        "search": lambda: D.search(iter(coded), model, anchors, 0.3), "verify": lambda: D.verify(iter([found]), items, 0.8, 0.6),
    }


@pytest.mark.parametrize("name", ["count_terms", "encode", "gram_times", "search", "verify"])
def test_memory_of_a_task(name):
    """About 40 MB of texts and 2 million terms in one batch; gram_times took 100 MB and more, search twice that."""
    small = {"count_terms": 4, "encode": 8, "gram_times": 40, "search": 60, "verify": 6}
    task = tasks(texts(2_000 if name == "verify" else 10_000))[name]
    tracemalloc.start()
    for _ in task():
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < small[name] * 1e6


def test_pieces_change_nothing(monkeypatch):
    batch = texts(300)

    def rows(out):
        got = pa.Table.from_batches(list(out)).to_pylist()
        return sorted((tuple(r.values()) for r in got), key=lambda x: (x[0], x[1], x[2] if len(x) > 2 else 0, -1 if x[-1] is None else 0))

    whole = {k: rows(f()) for k, f in tasks(batch).items()}
    monkeypatch.setattr(D, "TEXTS_AT_ONCE", 7)
    monkeypatch.setattr(D, "TERMS_AT_ONCE", 500)
    cut = {k: rows(f()) for k, f in tasks(batch).items()}
    assert cut["count_terms"] == whole["count_terms"] and cut["encode"] == whole["encode"] and cut["verify"] == whole["verify"]
    assert [x[:3] for x in cut["search"]] == [x[:3] for x in whole["search"]] and len(cut["search"]) > 20
    for a, b in zip(cut["gram_times"], whole["gram_times"], strict=True):
        assert a[:2] == b[:2] and np.allclose(np.frombuffer(a[2]), np.frombuffer(b[2]), rtol=1e-3, atol=0.05)
    assert [len(x) for x in ([*D.pieces(iter([batch.slice(0, 0).rename_columns(["doc_id", "terms"])]))],)] == [0]
