"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table


NAMES = ("log_words", "word_length", "distinct", "repeats", "upper", "marks", "symbols", "digits", "words_by_line")
#: The ASCII characters that some of the statistics count.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = b"|#$%&*<>=_^~@{}[]\\!"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def statistics_of(text: bytes | None) -> tuple[float, ...]:
    """The statistics NAMES of a whole text; every value is finite, null counts as empty."""
    text = text or b""
    words = text.split()
    n, size = len(words), max(1, len(text))
    share = lambda of: (len(text) - len(text.translate(None, of))) / size
    distinct = math.log(len(set(words))) / math.log(n) if n > 1 else 1.0
    again = sum(map(operator.eq, words, words[1:]))
    return (math.log1p(n), len(text) / max(1, n), distinct, again / max(1, n), share(UPPER), share(MARKS), share(SYMBOLS), share(DIGITS), n / (text.count(b"\n") + 1))


@F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in NAMES]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics_of(t) for t in texts], columns=list(NAMES), dtype="float64")


def with_statistics(rows: DataFrame) -> DataFrame:
    """rows with the struct _s of the statistics of text."""
    return rows.withColumn("_s", _statistics(F.col("text").cast("binary")))


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold))); a rule is a conjunction of (statistic, is_above, threshold)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: tuple, stats: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, above, at in rule:
        out = out & (stats[name] > at if above else stats[name] <= at)
    return out


def tree_rules(forest, names: list[str]) -> list[tuple]:
    """The conjunctive rules of all nodes below the roots of a fitted forest, each once."""
    found: dict[tuple, None] = {}

    def walk(node, path: dict) -> None:
        if path:
            found[tuple(sorted((n, a, t) for (n, a), t in path.items()))] = None
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, at = names[split.featureIndex()], float(split.threshold())
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            old = path.get((name, above))
            walk(child, path | {(name, above): at if old is None else max(old, at) if above else min(old, at)})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 20_000, trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on the labelled docs whose crc32(doc_id as text) mod 5 is not 0, or, where these are more than `fit_rows`,
    on about `fit_rows` of them chosen by a hash of doc_id: the one bounded sample here.

    Rules come from the paths of a random forest over the statistics; their weights from a lasso logistic regression.
    Null labels and ids are left out; a doc labelled twice takes its largest label; a labelled doc that occurs twice
    is used once for each occurrence. Without labelled docs, or with one class only, the score is the smoothed share
    of label 1.
    """
    own = labels.select("doc_id", F.col(label).cast("double").alias("_label")).where(f"doc_id is not null and _label is not null and not ({HELD_OUT})")
    own = materialize(own.groupBy("doc_id").agg(F.max("_label").alias("_label")), "labels")
    n = own.count()
    if n > fit_rows:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    names = list(NAMES)
    # at most about fit_rows rows: the bound that lets them be broadcast
    seen = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    train = materialize(with_statistics(seen).select("_label", "_s.*"), "labelled").coalesce(4)
    n, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    p = (ones + 1) / (n + 2)
    constant = RuleModel(math.log(p / (1 - p)), ())
    if ones in (0, n):
        return constant
    vectors = train.select("_label", array_to_vector(F.array(*names)).alias("x")).cache()
    forest = RandomForestClassifier(labelCol="_label", featuresCol="x", numTrees=trees, maxDepth=depth, subsamplingRate=0.7, minInstancesPerNode=max(1, min(20, n // 50)), seed=seed).fit(vectors)
    vectors.unpersist()
    if not (rules := tree_rules(forest, names)):
        return constant
    columns = {k: F.col(k) for k in names}
    coded = train.select("_label", array_to_vector(F.array(*[holds(r, columns).cast("double") for r in rules])).alias("x")).cache()
    fitted = LogisticRegression(labelCol="_label", featuresCol="x", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=40).fit(coded)
    coded.unpersist()
    return RuleModel(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, fitted.coefficients, strict=True) if w))


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)"


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= threshold). Null and empty texts are scored as empty;
    held_out is false for a null doc_id. Columns of these names are replaced, all others kept."""
    own = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    score = model.score({k: F.col(f"_s.{k}") for k in NAMES})
    rows = with_statistics(docs.select(F.struct(*own).alias("_own"), "doc_id", "text"))
    out = rows.select("_own.*", F.expr(HELD_OUT).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_rules(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
