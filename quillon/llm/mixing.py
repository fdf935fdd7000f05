"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, materialize, table
from .words import n_words

#: A document's place in the mix is a hash of this many bits, refined in levels of BITS / LEVELS bits.
BITS, LEVELS = 36, 3
STEP = BITS // LEVELS


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, taken (and copies = taken / size).

    Sources by code point, null last, weigh `weights` in turn and share `share` times all words; no target exceeds
    `cap` times its source's words, and what is cut off goes to the others by weight. A source takes each document
    floor(target / source_size) times, and once more those whose hash is below the source's threshold. The threshold
    is found from histograms of words by (source, hash bucket): only the bucket in which the budget ends is split
    again, LEVELS times in all; nothing is sorted. The last bucket is taken if that comes closer to the budget.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: hashes as the word null. Repeated doc_ids
    share a hash and are taken together. Empty table: no rows. Columns of these names are replaced,
    all others kept.
    """
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "copies")]
    h36 = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.struct(*own).alias("_own"), "source", n_words(F.col("text")).alias("size"), h36.alias("_h"))
    # the counts and hashes only, read LEVELS times
    sized = materialize(rows.select("source", "size", "_h").groupBy("source", "_h").agg(F.sum("size").alias("size")), "mix")

    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, before = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("_r", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    # one row for each source from here on; _r: the water level at which a source is full
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.select("*", weigh.alias("_w")).withColumn("_r", F.lit(cap) * F.col("source_size") / F.col("_w"))
    every = W.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))
    open_w = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    filled = ranked.withColumns({"_left": left, "_open": open_w}).withColumn("_full", F.col("_r") * F.col("_open") <= F.col("_left"))
    # those that stay open share what the full ones leave
    free = lambda c, z: F.sum(F.when(F.col("_full"), z).otherwise(F.col(c))).over(every)
    full_size = F.sum(F.when(F.col("_full"), F.lit(cap) * F.col("source_size")).otherwise(0)).over(every)
    target = F.when(F.col("_full"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise((F.lit(float(share)) * F.sum("source_size").over(every) - full_size) * F.col("_w") / free("_w", F.lit(0)))
    goal = filled.select("source", "source_size", target.alias("target")).withColumn("_k", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("_extra", F.col("target") - F.col("_k") * F.col("source_size"))
    goal = materialize(goal, "mix-goal")
    # a row for each source: broadcast only if they are few
    near = F.broadcast if goal.count() <= BROADCAST_ROWS else lambda df: df

    # bound: the bucket (as a prefix of the hash) in which a source's budget ends, and the words below it
    bound = goal.select(F.col("source").alias("_s"), "_extra", F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_below"))
    for level in range(1, LEVELS + 1):
        shift = BITS - level * STEP
        at = sized.join(near(bound), F.col("source").eqNullSafe(F.col("_s"))).where(F.shiftright("_h", shift + STEP) == F.col("_p"))
        hist = at.groupBy("source", "_extra", "_below", F.shiftright("_h", shift).alias("_p")).agg(F.sum("size").alias("_n"))
        run = W.partitionBy("source").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)  # at most 2 ** STEP rows for a source
        cum = hist.withColumn("_to", F.col("_below") + F.sum("_n").over(run))
        # the first bucket beyond the budget; without one (all fit) the last
        end = F.min(F.when(F.col("_to") > F.col("_extra"), F.struct("_p", (F.col("_to") - F.col("_n")).alias("_below"), "_n")))
        last = F.max(F.struct("_p", (F.col("_to") - F.col("_n")).alias("_below"), "_n"))
        bound = cum.groupBy("source", "_extra").agg(F.coalesce(end, last).alias("_e")).select(F.col("source").alias("_s"), "_extra", "_e.*")
    cut = bound.select("_s", F.when((F.col("_extra") - F.col("_below")) * 2 > F.col("_n"), F.col("_p") + 1).otherwise(F.col("_p")).alias("_cut"))
    ends = goal.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "source_size", "target", "_k", F.coalesce("_cut", F.lit(0).cast("long")).alias("_cut"))
    copies = F.col("_k") + F.when(F.col("_h") < F.col("_cut"), 1).otherwise(0)
    return rows.join(near(materialize(ends, "mix-cut")), F.col("source").eqNullSafe(F.col("_s"))).select("_own.*", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"))


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 9) AS BIGINT) AS h
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM t),
f AS (SELECT *, 2 * source_size / w AS lvl,
        1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER o, 0) AS lft,
        sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS opn
      FROM r WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, lvl * opn <= lft AS is_full FROM f),
goal AS (SELECT source, source_size,
        CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
             ELSE (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - sum(CASE WHEN is_full THEN 2 * source_size ELSE 0 END) OVER ()) * w
                  / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS k FROM goal),
x AS (SELECT *, target - k * source_size AS extra FROM e),
b AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
m AS (SELECT c.source, c.h, c.upto <= x.extra OR (c.upto - c.n <= x.extra AND (x.extra - (c.upto - c.n)) * 2 > c.n) AS more
      FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source)
SELECT d.doc_id, d.size, x.source_size, x.target, CAST(d.size * (x.k + CASE WHEN m.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.h = m.h
"""
