"""A log of row changes: appended in batches, read as a stream, replayed idempotently."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dml import apply_log


def append(log: DataFrame, path: str, first_lsn: int) -> None:
    """Write a commit: changes (op and the table's columns) with numbers from first_lsn in order of `seq`. Parquet's
    committer makes the commit's files visible together."""
    log.withColumn("lsn", F.col("seq") + first_lsn).drop("seq").write.mode("append").parquet(path)


def status(log: DataFrame, applied_lsn: int) -> DataFrame:
    """Changes by op: how many, the last lsn, and how many aren't applied yet."""
    return log.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.max("lsn").alias("max_lsn"), F.count(F.when(F.col("lsn") > applied_lsn, 1)).alias("unapplied"))


def recover(table: DataFrame, log: DataFrame, key: str, applied_lsn: int = -1) -> DataFrame:
    """The table with all changes beyond the snapshot's lsn."""
    return apply_log(table, log.where(F.col("lsn") > applied_lsn).select("lsn", "op", *table.columns), key)


class Snapshots:
    """Versions of a table under a folder: each a Parquet folder and a small JSON file that names it and its lsn; the
    highest-numbered one counts. Files go through Spark's file system, so the folder may be in any store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        return self.spark.read.schema("version long, data string, lsn long").json(f"{self.path}/manifest")

    def last(self) -> tuple[DataFrame, int, int]:
        r = self.versions().orderBy(F.desc("version")).first()
        return self.spark.read.parquet(f"{self.path}/{r.data}"), r.version, r.lsn

    def commit(self, table: DataFrame, version: int, lsn: int) -> None:
        data = f"v{version}-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{data}")
        row = json.dumps({"version": version, "data": data, "lsn": lsn})
        self.spark.range(1).select(F.lit(row).alias("value")).write.mode("append").text(f"{self.path}/manifest")


def follow(spark: SparkSession, log_path: str, log_schema: str, snapshots: Snapshots, key: str, checkpoint: str) -> StreamingQuery:
    """Apply a growing log to a table: each micro-batch becomes a version. A batch that comes again after a failure is
    recognised by its lsn: changes up to the snapshot's are left out."""

    def batch(changes: DataFrame, _: int) -> None:
        table, version, lsn = snapshots.last()
        if (top := changes.agg(F.max("lsn")).first()[0]) is not None and top > lsn:
            snapshots.commit(recover(table, changes, key, lsn), version + 1, top)

    stream = spark.readStream.schema(log_schema).parquet(log_path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
