import math
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm.quality import NAMES, RuleModel, fit_rules, op7_quality, score_quality, statistics_of


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def plain_score(model, text):
    """The model once more, without Spark."""
    stats = dict(zip(NAMES, statistics_of(None if text is None else text.encode()), strict=True))
    total = model.bias + sum(w for rule, w in model.rules if all((stats[n] > t) == above for n, above, t in rule))
    return 1 / (1 + math.exp(-total))


def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.fixture(scope="module")
def data(spark):
    """The tables that hold more labels."""
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def model(data):
    return fit_rules(*data)


def test_held_out_accuracy(spark, data):
    labels = {r.doc_id: r.quality for r in data[1].collect() if r.quality is not None}
    rows = op7_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == data[0].count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in rows)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(own) > 50 and auc(own) >= 0.95 and sum((s >= 0.3) == bool(y) for s, y in own) >= 0.9 * len(own)


def test_columns_equal_plain_rules(spark, model):
    texts = [None, "", " \n", "word", "Ä é ß", "a a a a", "Some plain words. And more of them, said twice.\n" * 40, "|||### $$ 1234 <b>", "x" * 100_000, "w " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in score_quality(df, model).collect()}
    assert model.rules and all(math.isclose(got[i], plain_score(model, t), rel_tol=1e-9) for i, t in enumerate(texts))


def test_rules_are_sparse_and_conjunctive(model):
    assert 0 < len(model.rules) <= 200 and all(w and 1 <= len(rule) <= 6 and all(n in NAMES for n, _, _ in rule) for rule, w in model.rules)


def test_held_out_labels_are_not_read(data, model):
    """The labels of held-out rows may be anything: the model stays the same."""
    docs, labels = data
    out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    other = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit_rules(docs, other) == model


def test_no_or_one_class(spark, data):
    docs, labels = data
    assert fit_rules(docs, labels.limit(0)) == RuleModel(0.0, ())
    ones = labels.withColumn("quality", F.lit(1))
    fitted = fit_rules(docs, ones)
    n = sum(not held(r.doc_id) for r in labels.collect())
    assert fitted.rules == () and math.isclose(plain_score(fitted, "x"), (n + 1) / (n + 2))
    assert score_quality(docs.limit(0), fitted).collect() == []


def test_edges(spark, model):
    rows = [(None, "x", "mine"), (1, None, "mine"), (1, None, "mine"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _s string")
    out = score_quality(df, model).collect()
    assert len(out) == 4 and [r.held_out for r in out if r.doc_id is None] == [False] and sorted(r._s or "" for r in out) == ["", "mine", "mine", "mine"]
    assert len({r.score for r in out if r.doc_id is not None}) == 1
