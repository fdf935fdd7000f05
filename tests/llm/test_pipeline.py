import corpus_pipeline
from pyspark.sql import functions as F
from quillon.llm.decontaminate import words

from test_pipeline_near import kept


def test_stages(spark, sf):
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        seen.append(docs.collect())
        docs = spark.createDataFrame(seen[-1], first.schema)
        assert docs.columns == first.columns
    start, good, lines, single, clean = ({r.doc_id: r for r in x} for x in seen)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ones, zeros = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert sum(i in good for i in ones) >= 0.95 * len(ones) and sum(i in good for i in zeros) <= 0.2 * len(zeros)
    assert set(good) == set(lines) and all(set(r.text.split("\n")) <= set(start[i].text.split("\n")) and r.n_chars == len(r.text) for i, r in lines.items())
    assert set(single) == kept([(r.doc_id, r.text) for r in lines.values()])  # five words and 0.8, not op5's three and 0.9
    items = [b" " + b" ".join(words(r.text.encode())) + b" " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i for i, r in single.items() if any(x in b" " + b" ".join(words(r.text.encode())) + b" " for x in items)}
    assert not held & set(clean) and len(set(single) - set(clean)) <= len(held) + 0.01 * len(single)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} <= set(clean) and all(r.taken == r.copies * r["size"] and 0 < r.copies <= 2 for r in out)


def test_foreign_columns(spark, sf):
    """Columns that an operator also makes or uses inside stay those of the documents, in every stage."""
    names = ["score", "predicted", "held_out", "n_lines", "n_dropped", "component_id", "vid", "rep", "row", "_own", "_host", "_s", "_h", "own", "key", "item"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.lit(f"mine {x}").alias(x) for x in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.select(*names).distinct().collect()
        assert name == "mixing" or out.columns == docs.columns
        assert [tuple(r) for r in rows] == [tuple(f"mine {x}" for x in names)], name


def test_run_and_empty(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "lang", "source", "n_chars", "taken"} <= set(out.columns) and out.count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
