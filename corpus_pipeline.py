"""A training corpus from the documents table: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, small, table
from quillon.llm.decontaminate import find_leaks
from quillon.llm.line_dedup import drop_boilerplate_lines
from quillon.llm.mixing import mix_sources
from quillon.llm.ngram_join import jaccard_groups
from quillon.llm.quality import fit_rules, score_quality


#: Bytes of an Arrow batch: a task holds several copies of one, in the JVM and in Python. Spark's own bounds, 10,000 rows and
#: 64 MB, let two tasks of an executor hold hundreds of MB of whole texts.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in batches of about BATCH_BYTES, as long as they may be: more batches,
    the same rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, and all of the row beside them, whatever names its columns have."""
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, fitted on the labels of the input, don't reject."""
    short_batches(spark)
    model = fit_rules(docs, table(spark, sf_dir, "labels"))
    return score_quality(whole(docs, "doc_id", "text"), model).where("predicted = 1").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; n_chars follows the text."""
    out = drop_boilerplate_lines(whole(docs, "text", "source"))
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": size}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates: documents whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more (op5 has its own bounds). Documents without a doc_id stay."""
    short_batches(spark)
    later = jaccard_groups(docs, width=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small(materialize(later, "later")), "doc_id", "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    short_batches(spark)
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(small(materialize(leaks, "leaking")), "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many times (copies) and how many words that are (taken)."""
    return mix_sources(docs).where("copies > 0")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed)]

#: SQL can't express the fitted rules and the latent search; tests/llm/test_pipeline.py checks each stage's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
