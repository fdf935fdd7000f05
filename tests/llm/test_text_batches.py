"""Memory of the pipeline's tasks: the mix sends no texts to Python, and the other stages send them in short batches."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.mixing import mix_sources
from quillon.llm.words import n_words


def test_the_mix_sends_no_texts_to_python(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * i) for i in range(20)], "doc_id long, source string, text string")
    plan = mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_number_of_words(spark):
    texts = [None, "", " ", "\n\t \x0b\x0c\r", "a", " a", "a ", "\r\n a\tb\x0bc\x0cd\re\nf ", "x x  x", "$1 \\ $", "\x00 \x00", "\x08a\x0e b", "a\x1cb\x1f\x85c d e", "é 𝄞 　", "b" * 300_000, " " * 300_000, "a " * 300_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", n_words(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    broken = [b"\xff\xfe a", b"a\xe9 b", b"\xe2\x20\x82 z", b"\xc0\x20\x20q"]
    rows = spark.createDataFrame(list(enumerate(broken)), "i int, text binary").select("i", n_words(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: len(t.split()) for i, t in enumerate(broken)}


def test_stages_send_short_batches(spark, sf):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))  # 20 MB in one partition
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for name in ("quality", "near_duplicates", "decontamination"):
            spark.conf.unset(key)
            dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
            sent = texts.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r.rows for r in sent) == 200, name
            assert max(r.bytes for r in sent) <= corpus_pipeline.BATCH_BYTES + 200_000, name
    finally:
        spark.conf.unset(key)
