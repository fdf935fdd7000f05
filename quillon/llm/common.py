"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join with no more rows than this may be broadcast (fixed-width rows of a few numbers).
BROADCAST_ROWS = 500_000
#: Sides with variable-width rows may be broadcast up to this many bytes.
BROADCAST_BYTES = 48 << 20
#: Tasks that a key's rows are dealt to where the other side of a join is too large to broadcast.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one on a local
    master (tests); a cluster without it is refused, as each executor would write to its own disk."""
    if (own := spark.conf.get("spark.checkpoint.dir", None)) or (own := spark.sparkContext.getCheckpointDir()):
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(own := tempfile.mkdtemp(prefix="quillon-"))
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. Files outlive any executor. As results
    are lazy, an operator can't know when they were read: whoever owns the folder clears it after the job, as for
    Spark's own checkpoints."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> bool:
    """Whether df may be broadcast: at most `rows` rows (and, with `size` = bytes of a row, at most BROADCAST_BYTES).
    Pass a materialized df: it is counted."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    return n <= rows and total <= BROADCAST_BYTES


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df, hinted for broadcast only if it `is_small`; otherwise unhinted, so that joins shuffle."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def hot_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", few: bool | None = None) -> DataFrame:
    """left joined with right, which has one row for each key, whatever the number of left's rows of a key: right is
    broadcast if it is small (`few`, where the caller knows); otherwise the rows of a key are dealt to SALTS tasks by a
    hash of all columns, and right is repeated for each."""
    if is_small(right) if few is None else few:
        return left.join(F.broadcast(right), on, how)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", salt).join(every, [on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in edges(a, b), null-free longs: component is the smallest id that is reachable.

    Each round every vertex takes the first of itself and its neighbours in some order, then what that one took, and the
    graph is contracted to these: all of them are reachable, so paths stay paths. The first order is that of the ids, so
    stars and cliques need one round; the others are random ones (a hash with the round's number), in which the vertices
    that keep edges become fewer by a constant factor on average: the rounds grow with the logarithm of the longest path.
    The smallest id of each contracted vertex is found at the end. Aggregations are partial and joins are `hot_join`s, so a
    hub is no single task's; each round's tables are written to the shared folder.
    """
    live = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    steps: list[tuple[DataFrame, bool]] = []
    while not live.isEmpty():
        place = (lambda c: F.col(c)) if not steps else (lambda c, k=len(steps): F.xxhash64(F.lit(k), c))
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("id")).agg(F.min(place("b")).alias("least"), F.min_by("b", place("b")).alias("b"))
        hop = materialize(first.select("id", F.when(F.col("least") < place("id"), F.col("b")).otherwise(F.col("id")).alias("to")), name)
        few = is_small(hop)
        hop = hot_join(hop, hop.select(F.col("id").alias("to"), F.col("to").alias("end")), "to", few=few).select("id", F.col("end").alias("to"))
        hop = hop if few else materialize(hop, name)
        steps.append((hop, few))
        moved = hot_join(live, hop.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a", few=few)
        moved = hot_join(moved, hop.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b", few=few).where("ta <> tb")
        # a vertex that took another hangs below it; its own neighbours reach the root through (to, neighbour's to)
        live = materialize(moved.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), name)
    if not steps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # an id's root is that of the id it was contracted into; later rounds only hold those that kept edges
    (out, few), *before = reversed(steps)
    for hop, more in before:
        ends = out.select(F.col("id").alias("to"), F.col("to").alias("end"))
        out, few = materialize(hot_join(hop, ends, "to", "left", few).select("id", F.coalesce("end", "to").alias("to")), name), more
    if len(steps) == 1:  # in the order of the ids the root is the smallest
        return out.withColumnRenamed("to", "component")
    least = materialize(out.groupBy("to").agg(F.min("id").alias("component")), name)
    return hot_join(out, least, "to").select("id", "component")
