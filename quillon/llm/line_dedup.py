"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, table


def drop_boilerplate_lines(docs: DataFrame, host: Column | None = None, ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """docs whose text has lost its host's boilerplate, with n_lines and n_dropped (non-blank lines).

    A line (trimmed of spaces) is boilerplate on a host if the host's pages that contain it are at least `min_pages`
    and more than `ratio` of the host's pages. Pages with the same text count once, so that many copies of a page do
    not turn its own lines into boilerplate. Lines are counted by a 64-bit hash of (host, line).

    A host has at most (lines per page / ratio) boilerplate lines, whatever its pages: they are gathered into an array
    for each host and filtered out inside the row, so texts never go through a shuffle while the hosts are few enough
    to broadcast (beyond BROADCAST_ROWS lines the join shuffles, and splits hot hosts).

    Null host: a host of its own. Null text stays null with 0 lines; blank lines are kept and not counted. All other
    columns (but those named n_lines and n_dropped) and all rows are kept; a text whose every line is boilerplate becomes
    empty.
    """
    host = F.col("source") if host is None else host
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*own).alias("_own"), "text", F.coalesce(host.cast("string"), F.lit("")).alias("_host"))
    split = F.split("text", "\n", -1)
    key = lambda x: F.xxhash64(F.col("_host"), F.trim(x))
    keys = F.array_distinct(F.transform(F.filter(split, lambda x: F.trim(x) != ""), key))
    pages = rows.where("text is not null").select("_host", F.xxhash64("text").alias("_page"), keys.alias("_keys"))
    total = pages.groupBy("_host", "_page").agg(F.lit(1)).groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    lines = pages.select("_host", "_page", F.explode("_keys").alias("_key"))
    # two steps: a page once, then pages; both reduce before the shuffle
    often = lines.groupBy("_host", "_key", "_page").agg(F.lit(1)).groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    found = often.join(total, "_host").where(F.col("_n") > ratio * F.col("_total"))
    bad = materialize(found.select("_host", "_key", "_n", "_total"), "boilerplate")
    by_host = bad.groupBy("_host").agg(F.collect_list("_key").alias("_bad"))
    by_host = F.broadcast(by_host) if bad.count() <= BROADCAST_ROWS else by_host
    none = F.array().cast("array<bigint>")
    # the page's own boilerplate, by a hash set of the host's; most pages have little or none
    keep = rows.join(by_host, "_host", "left").withColumn("_hit", F.array_intersect(keys, F.coalesce("_bad", none)))
    kept = F.array_join(F.filter(split, lambda x: ~F.array_contains(F.col("_hit"), key(x))), "\n")
    lines_of = lambda x: F.coalesce(F.size(F.filter(F.split(x, "\n", -1), lambda y: F.trim(y) != "")), F.lit(0))
    out = keep.withColumn("_text", F.when(F.size("_hit") > 0, kept).otherwise(F.col("text"))).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(lines_of(F.col("text"))).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - lines_of(F.col("_text"))).cast("long"))
    return out.select(*[F.col("_text" if c == "text" else f"_own.`{c}`").alias(c) for c in own], "n_lines", "n_dropped")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_boilerplate_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = """
WITH p AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),
tot AS (SELECT host, count(*) AS total FROM p GROUP BY host),
l AS (SELECT DISTINCT host, text, trim(line, ' ') AS line FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM p)),
bad AS (SELECT l.host, l.line FROM l JOIN tot USING (host) WHERE l.line <> ''
        GROUP BY l.host, l.line, tot.total HAVING count(*) >= 5 AND count(*) > 0.1 * tot.total),
b AS (SELECT host, list(line) AS lines FROM bad GROUP BY host),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, coalesce(b.lines, []) AS bl
      FROM documents LEFT JOIN b ON coalesce(source, '') = b.host),
k AS (SELECT doc_id, text, list_filter(ls, lambda x: trim(x, ' ') <> '') AS full_ls,
             list_filter(ls, lambda x: NOT list_contains(bl, trim(x, ' '))) AS kept FROM d)
SELECT doc_id, CAST(coalesce(len(full_ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(full_ls) - len(list_filter(kept, lambda x: trim(x, ' ') <> '')), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(array_to_string(kept, chr(10)), '')) END AS text_sha256
FROM k
"""
