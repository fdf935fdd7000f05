"""Scans, projections, joins, aggregates, sorting: the engine's operators as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import wrapped


class UnsupportedOperation(ValueError):
    """A combination that the engine rejects."""


# scans


def point_lookup(df: DataFrame, key: str, value: int) -> DataFrame:
    """The row of a key: an equality that prunes Parquet row groups."""
    return df.where(F.col(key) == value)


def key_exists(df: DataFrame, key: str, value: int) -> DataFrame:
    """One row: 1 if the key exists, else 0. Only the key column is read, up to the first match."""
    return df.where(F.col(key) == value).select(key).limit(1).agg(F.least(F.count(F.lit(1)), F.lit(1)).alias("found"))


def key_edge(df: DataFrame, key: str, largest: bool) -> DataFrame:
    return df.agg((F.max if largest else F.min)(key).alias("edge"))


def count_rows(df: DataFrame) -> DataFrame:
    """A scan of no columns."""
    return df.agg(F.count(F.lit(1)).alias("COUNT(*)"))


def index_scan(df: DataFrame, column: str, key: str) -> DataFrame:
    """(column, key) in the column's order, ties by key."""
    return df.select(column, key).orderBy(F.col(column).asc_nulls_first(), key)


# projections


def project(df: DataFrame, *items: str | Column | tuple[Column, str]) -> DataFrame:
    """Columns by name, "*" or "t.*", expressions (label: expr), or (expression, label)."""
    out = [x[0].alias(x[1]) if isinstance(x, tuple) else F.col(x) if isinstance(x, str) else x.alias("expr") for x in items]
    return df.select(*out)


def star(*sources: tuple[str, DataFrame]) -> list[Column]:
    """All columns of all sources in order; a name that occurs twice gets its source as prefix."""
    seen: dict[str, int] = {}
    for _, df in sources:
        for c in df.columns:
            seen[c.lower()] = seen.get(c.lower(), 0) + 1
    return [F.col(f"{name}.{c}").alias(c if seen[c.lower()] == 1 else f"{name}_{c}") for name, df in sources for c in df.columns]


# joins


def inner_join(first: tuple[str, DataFrame], *others: tuple[str, DataFrame, Column | bool]) -> DataFrame:
    """Left-deep inner joins of aliased sources, each with its own condition: equi joins hash or merge as Catalyst and AQE
    choose, others compare the sides directly. True is the cross product. Conditions see the sources so far."""
    out = first[1].alias(first[0])
    for name, df, on in others:
        side = df.alias(name)
        out = out.crossJoin(side) if on is True else out.join(side, on, "inner")
    return out


def keys_in_all(df: DataFrame, key: str, *sets: DataFrame) -> DataFrame:
    """Rows whose key is in every set (the first column of each)."""
    for s in sets:
        df = df.join(s.select(F.col(s.columns[0]).alias(key)), key, "left_semi")
    return df


# aggregates: the whole input, one row



def wrapping_sum(c: Column) -> Column:
    """The sum modulo 2^64 of a 64-bit column: three partial sums of 22 and 21 bits each, which can't overflow below 2^41
    rows, put together once at the end."""
    part = lambda shift: F.sum(F.shiftright(c, shift) if shift == 42 else F.shiftright(c, shift).bitwiseAND(F.lit((1 << 21) - 1))).cast("decimal(38,0)")
    whole = part(42) * F.lit(1 << 42).cast("decimal(14,0)") + part(21) * F.lit(1 << 21).cast("decimal(8,0)") + part(0)
    return wrapped(whole)


LABELS = {"count": "COUNT", "sum": "SUM", "min": "MIN", "max": "MAX", "avg": "AVG"}


def aggregate(df: DataFrame, *items: tuple[str, str] | tuple[str, str, str]) -> DataFrame:
    """(function, column or "*"[, label]) for COUNT, SUM, MIN, MAX and AVG. Nulls don't count; without rows COUNT is 0 and
    the others null. SUM of integers is a 64-bit integer that wraps around, text adds 0 to a SUM."""
    out = []
    for fn, column, *label in items:
        fn = fn.lower()
        if fn not in LABELS:
            raise UnsupportedOperation(fn)
        if column == "*":
            if fn != "count":
                raise UnsupportedOperation(f"{fn}(*)")
            out.append(F.count(F.lit(1)).alias(*(label or ["COUNT(*)"])))
            continue
        c = F.col(column)
        t = df.select(c.alias("c")).dtypes[0][1]
        if t in ("string", "binary") and fn in ("sum", "avg"):
            c = F.when(c.isNotNull(), F.lit(0))
        elif t in ("tinyint", "smallint", "int", "bigint") and fn == "sum":
            out.append(wrapping_sum(c.cast("bigint")).alias(*(label or [LABELS[fn]])))
            continue
        out.append(getattr(F, fn)(c).alias(*(label or [LABELS[fn]])))
    return df.agg(*out)


# order


def ordered(df: DataFrame, column: str | None, descending: bool = False, limit: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """ORDER BY one column, nulls first (last if descending), ties by the key; with a limit a top-k that sorts no more
    than the k rows of each partition. Without a column in the order of the key."""
    if limit is not None and limit < 0:
        raise UnsupportedOperation("negative limit")
    by = [F.col(x) for x in ties]
    if column is not None:
        by = [F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first(), *by]
    out = df.orderBy(*by) if by else df
    return out if limit is None else out.limit(limit)
