"""INSERT, UPDATE, DELETE and schema changes as copy-on-write transformations of a table's DataFrame.

Parquet files don't change: each statement is a projection, a filter or a union over the last version, which the caller
writes as the next one. A filter's negation keeps null rows where the engine would keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ColumnCountMismatch(ValueError):
    pass


class UnsupportedRowid(ValueError):
    pass


class DuplicateRowid(ValueError):
    pass


class RowidUpdateUnsupported(ValueError):
    pass


class ColumnAlreadyExists(ValueError):
    pass


class NoSuchTable(ValueError):
    pass


class TableAlreadyExists(ValueError):
    pass


class SchemaChangeInBatch(ValueError):
    pass


def matches(df: DataFrame, column: str, value: object) -> Column:
    """Typed exact equality; a null value matches null rows."""
    kind = df.schema[column].dataType.typeName()
    text = kind in ("string", "binary")
    if value is not None and isinstance(value, str) != text:
        return F.lit(False)
    return F.col(column).eqNullSafe(F.lit(value))


def insert_row(df: DataFrame, values: tuple, key: str | None = None) -> DataFrame:
    """One more row. A null key becomes the largest plus one; an explicit one must be above 0 and new."""
    if len(values) != len(df.columns):
        raise ColumnCountMismatch(f"{len(values)} values for {len(df.columns)} columns")
    row = dict(zip(df.columns, values, strict=True))
    if key is not None:
        if row[key] is None:
            row[key] = (df.agg(F.max(key)).first()[0] or 0) + 1
        elif not isinstance(row[key], int) or row[key] <= 0:
            raise UnsupportedRowid(row[key])
        elif not df.where(F.col(key) == row[key]).isEmpty():
            raise DuplicateRowid(row[key])
    one = df.sparkSession.range(1).select(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(one)


def update_where(df: DataFrame, column: str, value: object, where: str, equals: object, key: str | None = None) -> DataFrame:
    if column == key:
        raise RowidUpdateUnsupported(column)
    return df.withColumn(column, F.when(matches(df, where, equals), F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def delete_where(df: DataFrame, where: str, equals: object) -> DataFrame:
    return df.where(~matches(df, where, equals))


def changes(df: DataFrame, where: str, equals: object) -> DataFrame:
    """One row: how many rows an update or a delete with this condition changes."""
    return df.where(matches(df, where, equals)).agg(F.count(F.lit(1)).alias("changes"))


def batch(df: DataFrame, *statements: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table after several inserts, updates and deletes, each of which sees those before it: one transformation, written
    as one version. If one is refused none takes effect, as df itself doesn't change. Schema changes are refused."""
    out = df
    for change in statements:
        out = change(out)
        if out.dtypes != df.dtypes:
            raise SchemaChangeInBatch(f"{df.columns} to {out.columns}")
    return out


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    """Another name in the catalog for a table or view; its files stay where they are. An existing name is refused."""
    if not spark.catalog.tableExists(old):
        raise NoSuchTable(old)
    if spark.catalog.tableExists(new):
        raise TableAlreadyExists(new)
    kind = "VIEW" if spark.catalog.getTable(old).tableType in ("VIEW", "TEMPORARY") else "TABLE"
    spark.sql(f"ALTER {kind} {old} RENAME TO {new}")


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A nullable column at the end; old rows have null."""
    if name.lower() in map(str.lower, df.columns):
        raise ColumnAlreadyExists(name)
    return df.withColumn(name, F.lit(None).cast(kind))


def apply_log(df: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """The table after a log of changes (lsn, op, and the table's columns): insert, update and delete of whole rows by key.

    As if change by change in order of lsn: an insert of a key that is there and an update of one that isn't do nothing. So
    what counts is, after a key's last delete, its first insert and its last update. These are reduced before the shuffle,
    whatever the number of changes of a key; replaying a log twice, or a part of it again, changes nothing.
    """
    names = [c for c in df.columns if c != key]
    row = F.struct(F.col("lsn"), *names)
    gone = log.where("op = 'delete'").groupBy(key).agg(F.max("lsn").alias("_gone"))
    live = log.join(gone, key, "left").where("_gone is null or lsn > _gone")
    last = live.groupBy(key).agg(F.min_by(F.when(F.col("op") == "insert", row), F.when(F.col("op") == "insert", F.col("lsn"))).alias("_in"), F.max_by(F.when(F.col("op") == "update", row), F.when(F.col("op") == "update", F.col("lsn"))).alias("_up"))
    both = df.withColumn("_there", F.lit(True)).join(gone, key, "full").join(last, key, "full")
    there = F.coalesce("_there", F.lit(False)) & F.col("_gone").isNull()
    valid = F.col("_up").isNotNull() & (there | (F.col("_up.lsn") > F.col("_in.lsn")))
    new = F.when(valid, F.col("_up")).when(~there, F.col("_in"))
    out = both.where(there | F.col("_in").isNotNull()).withColumn("_new", new)
    return out.select(*[F.col(c) if c == key else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in df.columns])
