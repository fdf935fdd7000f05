"""Rows by their own text, and exact copies of texts, which later stages need not look at again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize

#: The contracts' white space.
SPACE = " \t\n\x0b\x0c\r"


def own_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, vid, text) of all rows, (vid, rep) of the exact copies among them, and (doc_id, vid) of the doc_ids that
    occur with several texts, None if there are none.

    vid stands for the row's own text: it is the doc_id, or, for doc_ids that occur with several texts, a hash of doc_id
    and text. Rows whose text a row with a smaller doc_id also has are copies; rep is the vid of the smallest such.
    One pass over the texts keeps 128-bit hashes, grouped twice with partial minima; a text that a third of all rows
    have is joined back by `hot_join`. Null ids and texts, and texts without a word, are no copies.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    number, own = F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text")
    known = rows.where("doc_id is not null and text is not null")
    said = F.ltrim(F.col("text").cast("string"), F.lit(SPACE)) != ""
    keys = materialize(known.select(number.alias("doc_id"), own.alias("own"), F.when(said, F.unhex(F.md5("text"))).alias("key")), "texts")
    clash = keys.groupBy("doc_id").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a < b")
    clash = materialize(clash.select(F.col("doc_id").alias("vid"), F.lit(True).alias("several")), "several-texts")
    several = None
    if clash.isEmpty():
        rows, keys = rows.withColumn("vid", number), keys.withColumn("vid", F.col("doc_id"))
    else:
        pick = lambda hashed: F.when(F.col("several"), hashed).otherwise(F.col("vid"))
        rows = hot_join(rows.withColumn("vid", number), clash, "vid", "left").withColumn("vid", pick(own))
        keys = hot_join(keys.withColumn("vid", F.col("doc_id")), clash, "vid", "left").withColumn("vid", pick(F.col("own")))
        several = materialize(rows.where("vid <> doc_id").select(number.alias("doc_id"), "vid").distinct(), "several")
    keys = keys.where("key is not null").select("doc_id", "vid", "key")
    reps = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("vid", "doc_id").alias("rep"))
    reps = materialize(reps.where("first < last").drop("last"), "copied-texts")
    copies = hot_join(keys, reps, "key").where("doc_id > first").select("vid", "rep").distinct()
    return rows.select("doc_id", "vid", "text"), materialize(copies, "copies"), several
