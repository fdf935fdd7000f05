"""Tables in Parquet, their description, and text and JSON output of results."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a declared type and the Spark type that they stand for, the first that fits.
AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
#: The integer key of each table that has one.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "benchmark": "item_id", "pages": "page_id", "embeddings": "vec_id"}


def affinity(declared: str) -> str:
    """The Spark type of a declared column type."""
    declared = declared.upper()
    return "binary" if not declared.strip() else next((t for w, t in AFFINITY if w in declared), "double")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one on a local master."""
    if own := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(own := tempfile.mkdtemp(prefix="quillon-"))
    return own


def describe(df: DataFrame, name: str) -> DataFrame:
    """A row for each column: table, position, name, type."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "table_name string, position int, column_name string, column_type string")


def with_rowid(df: DataFrame, order: list[str]) -> DataFrame:
    """A dense _rowid from 1 in an order that must be total, without a single-task sort: rows are ranged, counted by
    partition, and numbered from the partition's offset."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # the upper bits of the id are the partition, the lower 33 the row's place in it
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r.part, before))
        before += r.n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select((F.col("_before") + place + 1).alias("_rowid"), *df.columns)


def shown(value: object) -> str:
    return "NULL" if value is None else f"<blob {len(value)} bytes>" if isinstance(value, (bytes, bytearray)) else f"'{value}'" if isinstance(value, str) else str(value)


def as_text(df: DataFrame, name: str, key: str | None = None, limit: int = 1000) -> str:
    """A result as text; it is meant for people, so at most `limit` rows are shown, and how many there are."""
    rows = df.limit(limit + 1).collect()
    n = len(rows) if len(rows) <= limit else f"{df.count()}, the first {limit} shown"
    rows = rows[:limit]
    head = [f"table: {name}", f"columns: [{', '.join(df.columns)}]", f"rows: {n}"]
    return "\n".join(head + [f"{r[key] if key else '-'}: [{', '.join(f'{c}={shown(r[c])}' for c in df.columns)}]" for r in rows])


def json_error(code: str, message: str) -> str:
    return json.dumps({"status": "error", "error": code, "message": message, "results": [], "count": 0})
